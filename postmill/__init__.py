"""postmill: a Spark-native engine for curating and retrieving short social posts."""
