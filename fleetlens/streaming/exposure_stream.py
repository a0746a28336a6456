"""Exposure from a stream of events: the same rows as the batch for complete input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, *, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files in a folder, or of one file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return source.parquet(path)
    return source.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())


def windowed_activity(events: DataFrame, *, width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Events and their seconds by window and kind; state of windows older than the watermark is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 1_000_000).cast("bigint")).alias("duration_us"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "duration_us")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Stretches of a user's events with no gap of `gap` or more."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def run_to_table(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Drains a bounded stream into a table in a shared folder, and returns the last row of each key.

    Each batch adds what it changed (update mode), so closed windows leave the state, and nothing passes the driver. A
    batch that is run again overwrites itself."""

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    q = stream.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = stream.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch int").parquet(f"{folder}/rows")
    others = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_r"))
    return last.select(*[F.col("_r")[c].alias(c) if c in others else F.col(c) for c in stream.columns])


def late_rows(rows: DataFrame, source: list[str], arrival: str, order: list[str]) -> DataFrame:
    """Rows of a source that arrive after a later one: an input that has any is refused, none is dropped in silence."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*source).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_reach", F.max(F.struct(*order)).over(w)).where(F.struct(*order) < F.col("_reach")).drop("_reach")
