"""Structured Streaming: windows with late data, keyed state, incremental tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from orewright.session import shared_dir, table

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read(spark: SparkSession, path: str, schema: str | None = None, per_batch: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    r = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if per_batch:
        r = r.option("maxFilesPerTrigger", per_batch)
    return r.parquet(path)


def timed(events: DataFrame, t: str, late: str) -> DataFrame:
    """Events with a watermark; times without a zone are taken as the session's."""
    return events.withColumn(t, F.col(t).cast("timestamp")).withWatermark(t, late)


def windowed(events: DataFrame, t: str, late: str, size: str, slide: str | None = None, by: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """(start, by.., n, total) of event-time windows, tumbling or sliding; rows later than `late` are dropped."""
    w = F.window(t, size, slide) if slide else F.window(t, size)
    g = timed(events, t, late).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").alias("start"), *by, "n", "total")


def session_counts(events: DataFrame, t: str, late: str, gap: str, key: str) -> DataFrame:
    g = timed(events, t, late).groupBy(key, F.session_window(t, gap)).agg(F.count("*").alias("n"))
    return g.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def unseen(rows: DataFrame, t: str, late: str, *keys: str) -> DataFrame:
    """Only the first row of each key within the watermark, as rows come."""
    return timed(rows, t, late).dropDuplicatesWithinWatermark(list(keys))


def decaying(events: DataFrame, key: str, order: str, value: str, phi: float) -> DataFrame:
    """(key, order, value, resonance): the recurrence ``R = value + phi * R`` with one number of state a key.

    Rows of a batch are folded in their order; the last value is kept for the next batch.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k: tuple, batches, state: GroupState):  # noqa: ANN001, ANN202
        r = state.get[0] if state.exists else 0.0
        pdf = pd.concat([b for b in batches if len(b)] or [pd.DataFrame(columns=[key, order, value])]).sort_values(order, ignore_index=True)
        out = []
        for v in pdf[value]:
            r = float(v) + phi * r
            out.append(r)
        state.update((r,))
        yield pd.DataFrame({key: pdf[key], order: pdf[order], value: pdf[value], "resonance": out})

    kinds = dict(events.dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {value} {kinds[value]}, resonance double"
    return events.select(key, order, value).groupBy(key).applyInPandasWithState(step, schema, "r double", "append", GroupStateTimeout.NoTimeout)


def run(stream: DataFrame, name: str, mode: str = "append", spark: SparkSession | None = None) -> DataFrame:
    """Runs a stream over what there is now into a table of the shared folder and gives that table.

    A batch replaces its own folder, so one that is repeated after a failure counts once; in
    complete mode the last batch has everything.
    """
    s = spark or stream.sparkSession
    at = f"{shared_dir(s)}/orewright/stream-{name}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/table/{'all' if mode == 'complete' else f'batch={number}'}")

    q: StreamingQuery = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{at}/table")


#: Buckets of keys in the table of an incremental stream.
BUCKETS = 64


def incremental(spark: SparkSession, source: str, sink: str, key: str, digest: str, checkpoint: str) -> StreamingQuery:
    """Keeps `sink` (Parquet, one folder a batch) up to date with the rows of `source` whose digest is new.

    Each batch is compared with what the sink has by a left anti join on key and digest; of the
    sink only the buckets of the batch's keys are read.
    """

    def write(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        hashed = batch.withColumn("digest", F.md5(digest)).dropDuplicates([key, "digest"]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
        path = s.sparkContext._jvm.org.apache.hadoop.fs.Path(sink)
        if path.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).exists(path):
            mine = [r[0] for r in hashed.select("bucket").distinct().collect()]
            have = s.read.schema(StructType([*hashed.schema.fields, StructField("batch", LongType())])).parquet(sink)
            have = have.where(F.col("bucket").isin(mine) & (F.col("batch") != number)).select(key, "digest")
            hashed = hashed.join(have, [key, "digest"], "left_anti")
        hashed.write.mode("overwrite").partitionBy("bucket").parquet(f"{sink}/batch={number}")

    return read(spark, source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream."""
    t = table(spark, sf_dir, "events")
    return spark.readStream.schema(t.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
