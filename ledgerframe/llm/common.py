"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``.

    Only a local master may go without the setting (tests); a cluster without
    it is an error, because its executors share no temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _LOCAL_SCRATCH[app] = "file://" + tempfile.mkdtemp(prefix="llm-scratch-")
    return _LOCAL_SCRATCH[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to a new folder of the shared scratch folder and reads it
    back: its lineage ends there and a lost executor re-reads files."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Deletes a table that :func:`stored` wrote and nothing reads any more."""
    spark = table.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def given_back() -> None:
    """Returns the memory that Arrow keeps in reserve after a task's large batches: the Python worker
    goes on to tasks of other stages, which need their own."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))
