"""Sessions, the shared folder for cut lineage, and tables written into it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("weftline")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own: str | None = None
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset and the master is local.

    On a cluster without the setting this raises: a folder of the driver's machine isn't shared.
    """
    global _own
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own is None:
        holder = tempfile.TemporaryDirectory(prefix="weftline-", ignore_cleanup_errors=True)
        atexit.register(holder.cleanup)
        _own = holder.name
    return f"file://{_own}"


def shared_path(spark: SparkSession, name: str = "t") -> str:
    return f"{shared_dir(spark)}/weftline-{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)
    if path in _written:
        _written.remove(path)


def keep_path(spark: SparkSession, path: str) -> None:
    """Note a path in the shared folder: it goes as the tables of materialize() do."""
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    _written.append(path)


def materialize(df: DataFrame, name: str = "t") -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor costs no recomputation.

    The table goes when it is dropped, at release(), or at the latest when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    keep_path(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> int:
    """Delete all tables that materialize() has written and nobody dropped; results that weren't read yet are lost. Returns their number."""
    paths = list(_written)
    for path in paths:
        drop_path(spark, path)
    return len(paths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
