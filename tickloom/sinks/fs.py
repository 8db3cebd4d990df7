"""A few calls of the Hadoop file system API, so that paths may be on any store Spark can use.

They touch marker files, a batch's counts and folder names only, never data.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def glob(spark: SparkSession, pattern: str) -> list[str]:
    fs, jpath = _open(spark, pattern)
    return sorted(status.getPath().toString() for status in fs.globStatus(jpath) or [])


def create(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if it is there already."""
    fs, jpath = _open(spark, path)
    fs.mkdirs(jpath.getParent())
    return fs.createNewFile(jpath)


def put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file of text, replacing an earlier one."""
    fs, jpath = _open(spark, path)
    out = fs.create(jpath, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def marker(spark: SparkSession, folder: str, name: str) -> str | None:
    """The value of a marker file `<name>=<value>` in a folder, if there is one."""
    found = glob(spark, f"{folder}/{name}=*")
    return found[0].rsplit("=", 1)[1] if found else None


def delete(spark: SparkSession, path: str) -> None:
    fs, jpath = _open(spark, path)
    fs.delete(jpath, True)
