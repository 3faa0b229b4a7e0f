"""Writing posts, checkpoints and failures: Parquet for tables, and JSON lists for people and small tools."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.sources.files import written_text


def write_table(df: DataFrame, path: str) -> None:
    """Parquet, each partition its own file; the form that a large batch is kept in."""
    df.write.mode("overwrite").parquet(path)


def write_json_list(df: DataFrame, path: str, order_col: str = "idx", keep_order_col: bool = False, indent: int = 4) -> int:
    """One JSON list in the order of ``order_col``, streamed through the driver row by row; returns the number of rows."""
    fields = [c for c in df.columns if keep_order_col or c != order_col]
    rows = df.orderBy(F.col(order_col).asc_nulls_first()).select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("j"))
    n = 0
    with written_text(df.sparkSession, path) as file:
        file.write("[")
        for row in rows.toLocalIterator():
            text = json.dumps(json.loads(row.j), ensure_ascii=False, indent=indent)
            file.write(("," if n else "") + "\n" + "\n".join(" " * indent + line for line in text.split("\n")))
            n += 1
        file.write("\n]" if n else "]")
    return n


def write_checkpoint(posts: DataFrame, path: str) -> None:
    """The checkpoint file that ``read_checkpoint`` reads, in the order of idx."""
    records = posts.orderBy("idx").select(
        F.to_json(F.struct(F.col("idx").alias("index"), F.struct("text", "engagement", "line_count", "language", "tags").alias("post"))).alias("j")
    )
    with written_text(posts.sparkSession, path) as file:
        file.write('{"records": [')
        for n, row in enumerate(records.toLocalIterator()):
            file.write((", " if n else "") + row.j)
        file.write("]}")


def write_failures(failures: DataFrame, path: str) -> int:
    """The failures report: always a list, empty if nothing failed."""
    return write_json_list(failures.withColumnRenamed("idx", "index"), path, "index", keep_order_col=True, indent=2)
