"""Session settings, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the engine wants of a session it creates itself.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "orewright", **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword names use _ for the dots of a setting."""
    b = SparkSession.builder.appName(app)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the directory `sf_dir`."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bytes of a table from which :func:`texts` deals it to all cores.
SPREAD_FROM = 1 << 20


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are dear to work on. Where its files make fewer partitions than there are
    cores (a single row group makes one), its rows are dealt to all of them; larger tables,
    which have more, are read as they lie."""
    df = table(spark, sf_dir, name)
    if df._jdf.rdd().getNumPartitions() >= cores(spark):
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores(spark)) if size >= SPREAD_FROM else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Where that is unset and all runs
    on one machine (tests), a temporary folder is made and set for the session; on a cluster
    it is an error, as each machine would write to a folder of its own and read back a part."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        at = "file://" + tempfile.mkdtemp(prefix="orewright-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, removed by :func:`release`, or when the driver ends."""
    at = f"{shared_dir(spark)}/orewright/{name}-{uuid.uuid4().hex}"
    _written.append((spark, at))
    return at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage of `df` by writing it to the shared folder and reading it again.

    The written table survives the loss of executors, and what follows doesn't
    compute it a second time. The folder is removed by :func:`release`, or when the driver ends.
    """
    spark = df.sparkSession
    at = scratch(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def release() -> None:
    """Removes all written tables. Long sessions call it between queries, when nothing made from them is still to run."""
    while _written:
        spark, at = _written.pop()
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session is gone; a local folder can still be removed
            if at.startswith("file:"):
                shutil.rmtree(at.removeprefix("file://"), ignore_errors=True)


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


__all__ = ["DEFAULTS", "session", "table", "texts", "shared_dir", "scratch", "materialize", "release", "cores"]
