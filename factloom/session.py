"""Session helpers: where shared intermediate tables live, how lineage is cut, and how what was written goes away."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Folders that were written and not deleted yet, by the session's id.
_WRITTEN: dict[str, dict[str, SparkSession]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and all work is done by threads of this
    process, as in local tests, a folder of our own is made once per process; elsewhere that is an error, since
    executors on other machines would each write to a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="factloom-")
    return _OWN["dir"]


@dataclass(frozen=True)
class Written:
    """A table that was written: where, how to read it, and how many rows it has."""

    frame: DataFrame
    path: str
    rows: int


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, {})[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> Written:
    """Write ``df`` into the shared folder, and count its rows by the files' footers."""
    frame, path = _write(df, name)
    return Written(frame, path, frame.count())


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back.

    The written table survives the loss of executors, cuts the lineage, and is computed once however often the
    result is used. It stays until ``clean`` deletes it, at the latest when the process ends.
    """
    return _write(df, name)[0]


def drop(*tables: Written) -> None:
    """Delete tables that nothing will read any more."""
    _delete([t.path for t in tables])


def clean(spark: SparkSession) -> int:
    """Delete all that ``cut`` wrote in this application, and say how many tables that were.

    For the end of a query: what a query returned before can then no longer be read.
    """
    paths = _paths(spark)
    _delete(paths)
    return len(paths)


def _paths(spark: SparkSession) -> list[str]:
    return list(_WRITTEN.get(spark.sparkContext.applicationId, {}))


def _delete(paths: list[str]) -> None:
    for own in _WRITTEN.values():
        for p in [p for p in paths if p in own]:
            spark = own.pop(p)
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _at_exit() -> None:
    with suppress(Exception):  # the session may have ended
        _delete([p for own in _WRITTEN.values() for p in own])
