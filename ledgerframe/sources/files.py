"""Folders on whatever store Spark writes to, through the Hadoop FileSystem API:
what is complete, a stamp that changes with the content, and files put once."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def children(spark: SparkSession, parent: str) -> list[str]:
    """Names of the folders directly below ``parent``, sorted; none if it is absent."""
    fs, at = _open(spark, parent)
    if not fs.exists(at):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory())


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _open(spark, path)
    return fs.exists(at)


def is_complete(spark: SparkSession, folder: str) -> bool:
    """Whether a Spark job wrote the folder to its end."""
    return exists(spark, f"{folder}/_SUCCESS")


def stamp(spark: SparkSession, path: str) -> str:
    """Size, number of files and time of change of a file or folder ('' if absent)."""
    fs, at = _open(spark, path)
    if not fs.exists(at):
        return ""
    size = fs.getContentSummary(at)
    return f"{size.getLength()}:{size.getFileCount()}:{fs.getFileStatus(at).getModificationTime()}"


def names(spark: SparkSession, parent: str) -> list[str]:
    """Names of the files directly below ``parent``, sorted; none if it is absent."""
    fs, at = _open(spark, parent)
    if not fs.exists(at):
        return []
    found = (s.getPath().getName() for s in fs.listStatus(at) if s.isFile())
    return sorted(n for n in found if not n.startswith((".", "_")))


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _open(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Puts a whole file at ``path`` unless there is one: it is written under another name and
    renamed. False if another writer was first. The rename is atomic where the store's is (HDFS);
    on stores without one, a lock or conditional put of their own is needed for two writers."""
    fs, at = _open(spark, path)
    hidden = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
    out = fs.create(hidden, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(context.makeQualified(hidden), context.makeQualified(at), none)
    except Py4JJavaError as error:
        fs.delete(hidden, False)
        if "FileAlreadyExistsException" in str(error.java_exception.getClass().getName()):
            return False
        raise
    return True


def age_hours(spark: SparkSession, path: str) -> float:
    fs, at = _open(spark, path)
    return (time.time() * 1000 - fs.getFileStatus(at).getModificationTime()) / 3.6e6


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _open(spark, path)
    fs.delete(at, True)
