"""Helpers shared by the corpus operators: words, scratch tables, table reading."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a worker turns into Python objects at once, and bytes of an Arrow batch, so that long texts fit.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
#: Bytes that a file of a gathered table should hold.
FILE_BYTES = 32 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of an Arrow batch, where it is larger.

    Results are lazy, so the bound must still hold when the caller runs them; it is not put
    back. It has no effect on results, and a caller's own smaller bound stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def parts(batches: Iterator) -> Iterator:
    """Arrow batches, arrays or tuples of arrays, cut into such of at most ``BATCH_ROWS`` rows."""
    for b in batches:
        n = len(b[0]) if isinstance(b, tuple) else len(b) if isinstance(b, (pa.Array, pa.ChunkedArray)) else b.num_rows
        for i in range(0, n, BATCH_ROWS):
            yield tuple(c.slice(i, BATCH_ROWS) for c in b) if isinstance(b, tuple) else b.slice(i, BATCH_ROWS)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one is set only where none is named, and in local mode alone."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="gablestone-")
        sc.setCheckpointDir(named)
    return named


class Scratch:
    """Tables written to the shared folder, so that no later step depends on an executor.

    Each table is removed by ``drop`` or, at the latest, when the application ends.
    """

    def __init__(self, spark: SparkSession):
        bounded_batches(spark)
        self.spark = spark
        self.kept: list[str] = []
        #: Bytes that a gathered table may have, as far as its owner knows.
        self.size = 0
        self.root = f"{shared_folder(spark)}/gablestone-{uuid.uuid4().hex}"
        self._fs_path(self.root, on_exit=True)

    def _fs_path(self, path: str, on_exit: bool = False):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if on_exit:
            fs.mkdirs(p)
            fs.deleteOnExit(p)
        return fs, p

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_few(self, df: DataFrame, name: str) -> DataFrame:
        """As ``write``, for narrow tables of about ``size`` bytes: gathered into a file for each
        ``FILE_BYTES``, but a sixteenth of the shuffle's partitions at least."""
        n = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 16, -(-self.size // FILE_BYTES))
        return self.write(df.repartition(n), name)

    def keep(self, df: DataFrame) -> DataFrame:
        """A narrow table that several steps read, written as ``write_few`` does until ``release``."""
        self.kept.append(f"kept-{len(self.kept)}-{uuid.uuid4().hex[:8]}")
        return self.write_few(df, self.kept[-1])

    def release(self) -> None:
        """Remove what was kept; call it once what depends on it is written."""
        while self.kept:
            self.drop(self.kept.pop())

    def drop(self, name: str) -> None:
        fs, p = self._fs_path(f"{self.root}/{name}")
        fs.delete(p, True)


def first_by_hash(df: DataFrame, key: str, bound: int) -> DataFrame:
    """At most ``bound`` rows, chosen by a hash of the key and so alike in every run."""
    return df.orderBy(F.xxhash64(F.lit(17), F.col(key)), F.col(key)).limit(bound)


def free_prefix(df: DataFrame) -> str:
    """Underscores that no column's name begins with, for columns that come and go inside."""
    p = "_"
    while any(c.startswith(p) for c in df.columns):
        p += "_"
    return p
