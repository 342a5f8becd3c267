"""Incremental reuse: a table of derived rows by (path, content hash), kept for one configuration and schema version; and a file stream over it.

Each run writes a new version beside the last one, which is deleted when the new one stands; readers so never see a half-written table.
A version that can't be read counts as absent: the run computes everything and goes on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Changes with the columns of what is kept; tables of other versions are not read.
SCHEMA_VERSION = 1
KEY = ["path", "content_hash"]


def split_by_cache(files: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files, cached: path, content_hash. Rows to reuse, rows to compute, paths to purge."""
    known = cached.select(*KEY).distinct()
    return files.join(known, KEY, "left_semi"), files.join(known, KEY, "left_anti"), known.join(files.select("path"), "path", "left_anti").select("path").distinct()


@dataclass(frozen=True)
class Cache:
    """Derived rows of one configuration, below a folder that the driver and the executors share."""

    spark: SparkSession
    folder: str
    config_hash: str

    @property
    def path(self) -> str:
        return f"{self.folder}/schema-{SCHEMA_VERSION}/{self.config_hash}"

    def _fs(self, path: str):
        hadoop_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path

    def versions(self) -> list[int]:
        """Numbers of the versions that are there, complete or not."""
        fs, path = self._fs(self.path)
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(path)) if fs.exists(path) else []

    def read(self) -> DataFrame | None:
        """The newest version that is whole; one that can't be read is deleted."""
        for v in reversed(self.versions()):
            at = f"{self.path}/v{v}"
            fs, done = self._fs(f"{at}/_SUCCESS")
            if not fs.exists(done):
                continue
            try:
                kept = self.spark.read.parquet(at)
                kept.select(*KEY).count()  # reads every file
                return kept
            except (PySparkException, Py4JJavaError):
                fs.delete(self._fs(at)[1], True)
        return None

    def refresh(self, files: DataFrame, derive: Callable[[DataFrame], DataFrame], snapshot: bool = True) -> DataFrame:
        """Derived rows (path, content_hash, ...) of files (path, content_hash, ...), computed where there are none. A snapshot is all files
        there are: rows of others are purged. Otherwise files replace what is kept of their paths, and all other rows stay."""
        cached = self.read()
        if cached is None:
            return self._write(derive(files))
        hit, miss, _ = split_by_cache(files, cached)
        kept = cached.join(hit.select(*KEY).distinct(), KEY, "left_semi")
        if not snapshot:
            kept = kept.unionByName(cached.join(files.select("path").distinct(), "path", "left_anti").select(*cached.columns))
        return self._write(kept.unionByName(derive(miss)))

    def _write(self, rows: DataFrame) -> DataFrame:
        old = self.versions()
        target = f"{self.path}/v{old[-1] + 1 if old else 0}"
        rows.write.parquet(target)
        for v in old:
            fs, path = self._fs(f"{self.path}/v{v}")
            fs.delete(path, True)
        return self.spark.read.parquet(target)


def clear(spark: SparkSession, folder: str) -> bool:
    """Deletes everything that is kept below the folder; whether there was anything."""
    fs, path = Cache(spark, folder, "")._fs(folder)
    return bool(fs.exists(path) and fs.delete(path, True))


def refresh(spark: SparkSession, folder: str, config_hash: str, files: DataFrame, derive: Callable[[DataFrame], DataFrame], snapshot: bool = True) -> DataFrame:
    return Cache(spark, folder, config_hash).refresh(files, derive, snapshot)


def follow(spark: SparkSession, source: DataFrame, folder: str, config_hash: str, derive: Callable[[DataFrame], DataFrame], checkpoint: str):
    """A stream of files (path, text) into the cache: each batch replaces the rows of its paths, of which the last text by hash counts if
    one comes twice, and leaves all others. An extension; after all batches the rows are those of one run over the newest files."""

    def put(batch: DataFrame, _: int) -> None:
        files = batch.withColumn("content_hash", F.md5("text")).groupBy("path").agg(F.max(F.struct("content_hash", "text")).alias("x")).select("path", "x.content_hash", "x.text")
        if not files.isEmpty():
            refresh(spark, folder, config_hash, files, derive, snapshot=False)

    return source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
