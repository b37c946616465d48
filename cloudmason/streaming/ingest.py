"""Scenes as they arrive: an extension, the batch operators applied to micro-batches of points or annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cloudmason.operators import points as P


def point_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files of points, read as they appear."""
    return spark.readStream.schema(schema).parquet(path)


def class_counts(stream: DataFrame) -> DataFrame:
    """Running number of decoded points per scene and class."""
    return P.decoded(P.projected(stream)).groupBy("scene_id", "label").agg(F.count("*").alias("n"))


def late_annotations(stream: DataFrame, delay: str = "30 days", window: str = "7 days") -> DataFrame:
    """Annotations per scene and window of entry; rows that come later than the delay are left out."""
    return stream.withWatermark("entered_at", delay).groupBy(F.window("entered_at", window), "scene_id").agg(F.count("*").alias("n"))


def cluster_scenes(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Each batch of whole scenes is clustered and its objects appended to out; a batch that is run again overwrites its own part."""

    def batch(df: DataFrame, number: int) -> None:
        p = P.decoded(P.projected(df))
        P.objects_of(p, P.dbscan(p)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
