"""Incremental deduplication of a stream of chunks against the chunks seen before, kept as a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def dedup_stream(chunks: DataFrame, table: str, checkpoint: str, key: str = "hash", **trigger) -> StreamingQuery:
    """Append to the Parquet table the first chunk (key, pos) of each key that isn't in it yet.

    A batch's folder is named after the batch, so that one that is run again replaces what it wrote before.
    """

    def batch(df: DataFrame, number: int):
        spark = df.sparkSession
        new = df.groupBy(key).agg(F.min("pos").alias("pos"))
        try:
            seen = spark.read.parquet(table).where(F.col("batch") < number).select(key)
            new = new.join(seen, key, "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
