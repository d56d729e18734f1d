"""Tables kept as numbered versions, the current one named by a pointer file. One writer at a time, any number of readers."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from tomewright.sources.files import existing


def folder(path: str, n: int) -> str:
    return f"{path.rstrip('/')}/version={n}"


def hadoop(spark: SparkSession, path: str):
    """(file system, path object) of a folder, on whatever store it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    store, at = hadoop(spark, path)
    store.delete(at, True)


def started(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all version folders, ascending, also of those that a dead run left unfinished."""
    store, at = hadoop(spark, path)
    if not store.exists(at):
        return []
    names = [s.getPath().getName() for s in store.listStatus(at) if s.isDirectory()]
    return sorted(int(x.removeprefix("version=")) for x in names if x.startswith("version="))


def complete(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the completely written versions, ascending."""
    return [n for n in started(spark, path) if existing(spark, [folder(path, n) + "/_SUCCESS"])]


def point_to(spark: SparkSession, path: str, n: int) -> None:
    """Make version ``n`` the current one: a pointer file is replaced by a rename, so readers see the old or the new."""
    jvm = spark._jvm
    store, _ = hadoop(spark, path)
    temporary = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_current-{uuid.uuid4().hex}")
    out = store.create(temporary, True)
    out.write(bytearray(str(n).encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    pointer = store.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_current"))
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(pointer.toUri(), spark._jsc.hadoopConfiguration())
    files.rename(store.makeQualified(temporary), pointer, how)


def current(spark: SparkSession, path: str) -> int | None:
    """The version the pointer names; None without any."""
    pointer = f"{path.rstrip('/')}/_current"
    if not existing(spark, [pointer]):
        return None
    store, at = hadoop(spark, pointer)
    stream = store.open(at)
    try:
        return int(bytes(stream.readNBytes(32)).decode())
    finally:
        stream.close()
