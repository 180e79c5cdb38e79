"""What lies at a path, asked of the file system that holds it."""

from __future__ import annotations

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """The path as the file system knows it, and the file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listing(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """Name, length and time of every file at a path: changes when the data does."""
    where, files = file_system(spark, path)
    found, each = [], files.listFiles(where, True)
    while each.hasNext():
        file = each.next()
        found.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
    return tuple(sorted(found))


def move(spark: SparkSession, path: str, target: str) -> bool:
    """Give what lies at ``path`` the name ``target``, which nothing has yet; False if nothing lies there."""
    where, files = file_system(spark, path)
    if not files.exists(where):
        return False
    goal, _ = file_system(spark, target)
    files.mkdirs(goal.getParent())
    if files.exists(goal) or not files.rename(where, goal):
        raise OSError(f"{path} cannot be moved to {target}")
    return True


def remove(spark: SparkSession, path: str) -> None:
    where, files = file_system(spark, path)
    files.delete(where, True)


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of a text file, compressed or not, without reading more of it."""
    where, files = file_system(spark, path)
    jvm = spark.sparkContext._jvm
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(
        spark.sparkContext._jsc.hadoopConfiguration()).getCodec(where)
    stream = files.open(where)
    try:
        if codec is not None:
            stream = codec.createInputStream(stream)
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine() or ""
    finally:
        stream.close()


def parts_of(spark: SparkSession, path: str) -> list[str]:
    """The data files of a folder, or the file itself; names that begin with a dot or an underscore are not data."""
    where, files = file_system(spark, path)
    found = [s for s in files.listStatus(where) if s.isFile() and s.getPath().getName()[0] not in "._"]
    return sorted(s.getPath().toString() for s in found)


def matching(spark: SparkSession, pattern: str) -> dict[str, bool]:
    """Names that match a path pattern, and whether each is a folder."""
    where, files = file_system(spark, pattern)
    return {s.getPath().getName(): s.isDirectory() for s in files.globStatus(where) or []}
