"""Tables in the folder that all executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors and the driver see.

    ``spark.checkpoint.dir`` names it on a cluster.  Only a local master may do
    without: there a temporary folder is set, once per context.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="objtrail-"))
    return context.getCheckpointDir().rstrip("/")


#: nobody waits for a marker of these tables; a local file system starts a process for the mode of every file, so
#: there is no checksum file beside each (schemes other than file do not heed that)
_QUIET = {
    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false",
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
}
#: narrow rows that a file of a small table holds
ROWS_PER_FILE = 250_000


class Stored:
    """A table written to the shared folder, cutting the lineage before it.

    ``rows``, where a bound of its rows is known, keeps a small table from being
    spread over a file for every shuffle partition.  It narrows the last stage too, so
    it is for tables whose last stage is light.
    """

    def __init__(self, df: DataFrame, label: str, rows: int | None = None, per_file: int = ROWS_PER_FILE) -> None:
        self.spark = df.sparkSession
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // per_file)))
        self.path = f"{shared_folder(self.spark)}/{label}-{uuid.uuid4().hex}"
        self.schema = df.schema
        df.write.options(**_QUIET).parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files; only for tables that no later result reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def store(df: DataFrame, label: str, rows: int | None = None, per_file: int = ROWS_PER_FILE) -> DataFrame:
    return Stored(df, label, rows, per_file).df


class Scratch:
    """Tables that an operator needs until its last one is written."""

    def __init__(self) -> None:
        self.tables: list[Stored] = []

    def store(self, df: DataFrame, label: str, rows: int | None = None, per_file: int = ROWS_PER_FILE) -> DataFrame:
        self.tables.append(Stored(df, label, rows, per_file))
        return self.tables[-1].df

    def drop(self) -> None:
        """Delete them all; what is still to be read must be stored elsewhere."""
        while self.tables:
            self.tables.pop().drop()
