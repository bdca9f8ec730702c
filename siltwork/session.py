"""Session defaults, and tables written to the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Spark deletes the shuffle files of a write once it is done
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: bytes of a row group of written tables: small, as each task that writes holds one
ROW_GROUP = 16 << 20
#: rows of a file of a written table, and documents whose texts a task reads for one
FILE_ROWS, FILE_DOCS = 1 << 16, 1 << 12
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("siltwork")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only on one machine may it be unset, and is one set here."""
    conf = spark.sparkContext.getConf()
    named = spark.sparkContext.getCheckpointDir() or conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "siltwork-checkpoints")


def cut_lineage(df: DataFrame, rows: int | None = None, per_file: int = FILE_ROWS) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it from there.

    Where it is known that there are at most so many rows (or documents that the rows come from), they go to as many files
    as they fill, but no fewer than there are cores, so that small tables make few files and every core has work.

    Lost executors then cost no recomputing, columns that aren't asked for aren't read again, and the planner knows the
    table's size. The shuffle files of the write go at its end. `free` deletes the table; one that a result still reads
    stays, as checkpoint files do.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/siltwork-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // per_file)))
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**{"parquet.block.size": str(ROW_GROUP), "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def is_written(df: DataFrame) -> bool:
    """Whether cut_lineage has written df, and it is still there."""
    return df in _written


def free(*tables: DataFrame) -> None:
    """Delete tables that cut_lineage has written; nothing may read them later."""
    for df in tables:
        path = _written.pop(df, None)
        if path is not None:
            jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
