"""DELTA mode as a stream: each micro-batch is normalized, compared with the known hashes, and what is new is appended.

The known hashes are a table laid out by classes of the hash; a batch reads its own classes only, and none is collected. What
one source has delivered is no news from it, but may be from another. A batch that is run again after a failure finds its own
records known, so every record is appended once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinmesh.operators.normalize import normalize
from kinmesh.storage import exists


CLASSES = 1024


def new_records(batch: DataFrame, known: DataFrame | None) -> DataFrame:
    """Normalized records of a batch whose content their own source hasn't delivered; equal ones in the batch leave the first."""
    norm = normalize(batch)
    first = norm.groupBy("source_system", "record_hash").agg(F.min_by(F.struct(*norm.columns), "ingest_seq").alias("r")).select("r.*")
    return first if known is None else first.join(known.select("source_system", "record_hash"), ["source_system", "record_hash"], "left_anti")


def _part() -> Column:
    """The class of a hash by which the known records are laid out: its first digits."""
    return F.pmod(F.xxhash64("record_hash"), F.lit(CLASSES)).cast("int")


def append_new(batch: DataFrame, known_path: str) -> None:
    """Appends what is new; of the known records only the classes that the batch's hashes fall into are read."""
    spark = batch.sparkSession
    fresh = new_records(batch, None).drop("metadata").withColumn("part", _part())
    if exists(spark, known_path):
        parts = [r["part"] for r in fresh.select("part").distinct().collect()]  # at most CLASSES numbers
        known = spark.read.parquet(known_path).where(F.col("part").isin(parts)).select("source_system", "record_hash")
        fresh = fresh.join(known, ["source_system", "record_hash"], "left_anti")
    fresh.repartition("part").write.mode("append").partitionBy("part").parquet(known_path)


def start(stream: DataFrame, known_path: str, checkpoint: str) -> StreamingQuery:
    """Runs the stream's available records through append_new()."""
    return stream.writeStream.foreachBatch(lambda df, _: append_new(df, known_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
