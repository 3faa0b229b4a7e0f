"""The batch over a stream of raw posts: each micro-batch is enriched and appended; a restart repeats none of it."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postmill.operators.enrich import ClientFactory, process_posts
from postmill.operators.quality import add_clean_columns
from postmill.sources.files import exists


def enrich_stream(raw: DataFrame, out_dir: str, make_client: ClientFactory, languages: tuple[str, ...] = ("English", "Hinglish")) -> StreamingQuery:
    """Starts a query that enriches new raw posts (``idx, text, engagement``) and writes posts and failures below ``out_dir``.

    Posts are one table, partitioned by micro-batch; a micro-batch that is repeated after a failure overwrites its own
    partition. Posts that an earlier micro-batch has written are skipped. Duplicates are resolved within a micro-batch. A
    null idx is left out; a text that is blank, or has nothing to be seen in it, becomes a failure and stops nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.where("idx IS NOT NULL")
        if exists(spark, f"{out_dir}/posts"):
            earlier = spark.read.parquet(f"{out_dir}/posts").where(F.col("batch") < number)
            fresh = fresh.join(earlier.select("idx"), "idx", "left_anti")
        done = process_posts(fresh, make_client, languages=languages, blank_fails=True)
        for frame, name in ((done.posts, "posts"), (done.failures, "failures")):
            frame.write.mode("overwrite").parquet(f"{out_dir}/{name}/batch={number}")

    return raw.writeStream.foreachBatch(step).option("checkpointLocation", f"{out_dir}/progress").trigger(availableNow=True).start()


def quality_stream(raw: DataFrame, time_col: str = "scraped_at", late: str = "7 days", window: str = "1 day") -> DataFrame:
    """Streaming counts of posts by day and reason against them (``ok`` for none), late rows admitted up to the watermark."""
    judged = add_clean_columns(raw.withWatermark(time_col, late))
    return judged.groupBy(F.window(time_col, window), F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n_posts"))


def first_copies(raw: DataFrame, time_col: str = "scraped_at", late: str = "7 days") -> DataFrame:
    """A stream without repeats of a fingerprint, as long as the watermark remembers it."""
    judged = add_clean_columns(raw.withWatermark(time_col, late)).where("fp <> ''")
    return judged.dropDuplicatesWithinWatermark(["fp"])


