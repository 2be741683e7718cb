"""Table access, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes (estimated by :func:`row_bytes`) up to which a side may be broadcast; they are summed before the join.
BROADCAST_BYTES = 32 << 20
_LOCAL = threading.local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Where that is unset, an error on a cluster; a temporary folder in local mode, where driver and executors are one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = getattr(shared_dir, "own", None)
        if at is None:
            at = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
            atexit.register(shutil.rmtree, at[7:], True)
    return at.rstrip("/")


def _remember(path: str) -> None:
    for made in getattr(_LOCAL, "made", [])[-1:]:
        made.append(path)


@contextmanager
def _setting(spark: SparkSession, key: str):
    """Switches a setting on and restores it afterwards."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old) if old is not None else spark.conf.unset(key)


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written once to the shared folder and read back: later jobs start from the files, so a lost executor costs no recomputation of what went before.

    Shuffle files of the write are deleted when it ends; else those of all steps lie on the disks until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"):
        df.write.parquet(path)
    _remember(path)
    return spark.read.schema(df.schema).parquet(path)


def measured_cut(df: DataFrame, name: str = "t", **measures: Column) -> tuple[DataFrame, dict]:
    """:func:`cut`, and aggregates of the rows taken while they are written, ``n`` (their number) by default; so loops need no job to see whether they are done."""
    seen = Observation()
    out = cut(df.observe(seen, *[c.alias(k) for k, c in (measures or {"n": F.count(F.lit(1))}).items()]), name)
    return out, seen.get


def _delete(path: str) -> None:
    """Removes a folder of the shared file system. What cannot be removed stays; it is not read again."""
    try:
        if path.startswith("file:") or os.path.isdir(path):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), True)
        else:
            from pyarrow import fs

            system, inner = fs.FileSystem.from_uri(path)
            system.delete_dir(inner)
    except (OSError, ValueError, ImportError):
        pass


def drop_cut(df: DataFrame) -> None:
    """Deletes the files of a frame made by :func:`cut`, once nothing reads it any more."""
    for folder in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        _delete(folder)


def _frames(result) -> list[DataFrame]:
    if isinstance(result, DataFrame):
        return [result]
    if isinstance(result, dict):
        result = result.values()
    return [f for r in result for f in _frames(r)] if isinstance(result, (tuple, list, type({}.values()))) else []


def tidy(operator):
    """Marks an operator whose cuts are deleted when it returns, all but those its result still reads. The latter pass to the operator that called it, or are deleted when the process ends."""

    @functools.wraps(operator)
    def run(*args, **kwargs):
        stack = _LOCAL.made = getattr(_LOCAL, "made", [])
        stack.append([])
        try:
            result = operator(*args, **kwargs)
        finally:
            made = stack.pop()
        read = {p.rsplit("/", 2)[1] for f in _frames(result) for p in f.inputFiles()} if made else set()
        for path in made:
            if path.rsplit("/", 1)[1] not in read:
                _delete(path)
            elif stack:
                stack[-1].append(path)
            else:
                atexit.register(_delete, path)
        return result

    return run


def row_bytes(df: DataFrame) -> Column:
    """Estimated size of a row in memory: text by its length, arrays and structs by their JSON text, other values by 16 bytes."""
    parts = [F.lit(16 * len(df.columns))]
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary", "varchar", "char"):
            parts.append(F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)))
        elif kind in ("array", "struct", "map"):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0)))
    return functools.reduce(lambda a, b: a + b, parts).cast("long")


def checked_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows are estimated at no more than ``most`` bytes together, else as it is (Spark then shuffles both sides and AQE splits skewed partitions)."""
    size = df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= most else df


@contextmanager
def skew_safe(spark: SparkSession):
    """Lets AQE split skewed join partitions even where that adds a shuffle; restores the setting afterwards.

    AQE splits a side only where it is a bare shuffle, so a side grouped by the join key must be :func:`cut` first. The join must also
    run inside the block: a frame returned from it is planned with the setting of whoever runs it.
    """
    with _setting(spark, "spark.sql.adaptive.forceOptimizeSkewedJoin"):
        yield
