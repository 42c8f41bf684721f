"""Folder questions to the file system that Spark itself uses (local, HDFS, object stores)."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _at(spark, path)
    return files.exists(target)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern."""
    files, target = _at(spark, pattern)
    return [s.getPath().toString() for s in files.globStatus(target) or []]


def remove_folder(spark: SparkSession, path: str) -> None:
    files, target = _at(spark, path)
    files.delete(target, True)


def make_folder_of_session(spark: SparkSession, path: str) -> None:
    """Make a folder, if need be, that is removed when the session's JVM ends."""
    files, target = _at(spark, path)
    files.mkdirs(target)
    files.deleteOnExit(target)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark reads it from."""
    files, target = _at(spark, path)
    found = files.makeQualified(target).toString()
    return found.replace("file:/", "file:///", 1) if found.startswith("file:/") and not found.startswith("file://") else found


def read_text(spark: SparkSession, path: str) -> str:
    files, target = _at(spark, path)
    stream = files.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that is not there yet, whole or not at all; False if it is there.

    The text goes to a file of another name, which is then renamed; a rename that replaces nothing is one step on
    HDFS. Where a store lacks such a rename, only one writer at a time is safe.
    """
    jvm = spark._jvm
    files, target = _at(spark, path)
    own = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = files.create(own, False)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(own, files.makeQualified(target), spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        files.delete(own, False)
        if files.exists(target):
            return False
        raise e
    return True


def bytes_below(spark: SparkSession, path: str) -> int:
    files, target = _at(spark, path)
    return files.getContentSummary(target).getLength()


def folder_entries(spark: SparkSession, path: str) -> list[tuple[str, bool, int]]:
    """(path, whether it is a folder, milliseconds of its last change) of what lies directly in a folder."""
    files, target = _at(spark, path)
    if not files.exists(target):
        return []
    return [(s.getPath().toString(), s.isDirectory(), s.getModificationTime()) for s in files.listStatus(target)]
