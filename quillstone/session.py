"""Session and storage helpers shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Executors need no copy of the package: its functions travel with the plan that uses them.
cloudpickle.register_pickle_by_value(sys.modules["quillstone"])


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillstone")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; the path may be of any Hadoop file system."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local_dirs: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where that is unset, a session on one machine gets its own, deleted at exit."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _local_dirs:
        path = tempfile.mkdtemp(prefix="spark-quillstone-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _local_dirs[context.applicationId] = path
    return "file://" + _local_dirs[context.applicationId]


#: Bytes of a row group of wide rows, whose sizes Parquet would look at after a hundred rows only: a writer and a reader hold about this much.
WIDE = 16 << 20


def cut(df: DataFrame, partition_by: str | None = None, wide: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs only a reread. wide: a row may take megabytes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillstone-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if wide:
        writer = writer.options(**{"parquet.block.size": WIDE, "parquet.page.size.row.check.min": 1})
    writer.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> int:
    """Delete the tables cut() has written in this process and say how many there were; results that still read them must be written first."""
    n = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
