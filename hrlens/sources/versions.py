"""All-or-nothing publishing of a set of tables.

Each publish writes all tables to a folder of its own, ``<dir>/versions/<id>``,
and then replaces one small pointer file, ``<dir>/_CURRENT``, that names it.
Readers follow the pointer, so they see the tables of one publish, the old or
the new: a job killed at any time before the pointer is replaced leaves the
old set as it was. A folder without pointer is read as it is.

The pointer goes through Hadoop's file systems, so it works wherever Spark
writes; it is renamed into place, which is atomic on HDFS and local disks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hrlens.sources.sinks import write_table

POINTER = "_CURRENT"


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _context(spark: SparkSession, path: str):
    conf = spark._jsc.hadoopConfiguration()
    uri = _path(spark, path).getFileSystem(conf).makeQualified(_path(spark, path)).toUri()
    return spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, conf)


def current(spark: SparkSession, data_dir: str) -> str:
    """The folder of the current version; ``data_dir`` where there is none."""
    pointer = _path(spark, f"{data_dir}/{POINTER}")
    fs = pointer.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(pointer):
        return data_dir
    stream = fs.open(pointer)
    try:
        version = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()
    return f"{data_dir}/versions/{version}"


def point(spark: SparkSession, data_dir: str, version: str) -> None:
    """Make ``version`` the current one."""
    new = f"{data_dir}/{POINTER}.{uuid.uuid4().hex}"
    fs = _path(spark, new).getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(_path(spark, new), True)
    try:
        out.write(bytearray(version, "utf-8"))
    finally:
        out.close()
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    _context(spark, data_dir).rename(_path(spark, new), _path(spark, f"{data_dir}/{POINTER}"), how)


def publish(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    data_dir: str,
    fmt: str = "parquet",
    partition_by: dict[str, list[str]] | None = None,
) -> str:
    """Write ``tables`` as a new version and make it the current one; its id.
    Older versions stay, for readers under way, until ``drop_old``."""
    version = uuid.uuid4().hex
    for name, df in tables.items():
        write_table(df, f"{data_dir}/versions/{version}", name, fmt, (partition_by or {}).get(name))
    point(spark, data_dir, version)
    return version


def versions(spark: SparkSession, data_dir: str) -> list[str]:
    """Versions by time of writing, whether published or left by a killed job."""
    folder = _path(spark, f"{data_dir}/versions")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = list(fs.listStatus(folder)) if fs.exists(folder) else []
    return [f.getPath().getName() for f in sorted(found, key=lambda f: (f.getModificationTime(), f.getPath().getName()))]


def drop_old(spark: SparkSession, data_dir: str, keep: int = 2) -> list[str]:
    """Delete all but the ``keep`` newest versions and the current one."""
    now = current(spark, data_dir).rsplit("/", 1)[-1]
    old = [v for v in versions(spark, data_dir)[: -keep or None] if v != now]
    fs = _path(spark, data_dir).getFileSystem(spark._jsc.hadoopConfiguration())
    for v in old:
        fs.delete(_path(spark, f"{data_dir}/versions/{v}"), True)
    return old
