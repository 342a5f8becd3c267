"""Session helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="weft-checkpoint-"))
        found = context.getCheckpointDir()
    return found


#: Records of an Arrow batch at most: texts may be long, and a batch is held whole on both sides.
BATCH = 1000
#: Rows of a file of a table of short rows.
ROWS_A_FILE = 250_000
#: The tables that cut() has written, as long as a block of tables_of() lasts.
_open: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and each row is computed once. rows: how many short
    rows there are about, for a number of files that fits. Arrow batches of the session are kept to BATCH records."""
    spark = df.sparkSession
    small_batches(spark)
    if rows is not None:
        df = df.coalesce(rows // ROWS_A_FILE + 1)
    path = f"{shared_folder(spark)}/weft-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    for held in _open:
        held.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.weft_path = path
    return out


def small_batches(spark: SparkSession) -> None:
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def held(df: DataFrame) -> DataFrame:
    """df, computed now and kept on the executors' disks: for what is read several times before the next cut(). What a lost
    executor held is computed again."""
    small_batches(df.sparkSession)
    df = df.persist(StorageLevel.DISK_ONLY)
    df.count()
    return df


def release(*frames: DataFrame) -> None:
    """Delete what held(), or the table that cut(), has written; no later plan may read it."""
    for df in frames:
        if hasattr(df, "weft_path"):
            _delete(df.sparkSession, df.weft_path)
        else:
            df.unpersist()


@contextmanager
def tables_of(spark: SparkSession) -> Iterator[set[str]]:
    """Deletes at its end what cut() has written within, but for the paths that are put into the set it gives."""
    keep: set[str] = set()
    _open.append([])
    try:
        yield keep
    finally:
        for path in _open.pop():
            if path not in keep:
                _delete(spark, path)


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(-1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(df: DataFrame, each: int) -> int:
    """Parts for what a pass over df makes: twice the shuffle partitions, or more so that each part is of about ``each`` bytes
    of df as Spark estimates its size. The results don't depend on it."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(2 * shuffle_partitions(df.sparkSession), size // each if size < 1 << 56 else 0)
