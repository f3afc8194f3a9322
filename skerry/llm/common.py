"""Shared helpers: scratch tables in the cluster's shared folder, word rules."""

from __future__ import annotations

import contextlib
import contextvars
import pickle
import re
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import spread

#: A word is a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own: list[str] = []
_scopes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; in local mode, where none is set, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="skerry-"))
    return _own[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/skerry-{uuid.uuid4().hex}-{name}"
    for made in _scopes.get():
        made.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage in a way that survives lost executors, and gives later
    joins true size statistics.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch_scope():
    """A list of the scratch tables that are made within, by this thread."""
    made: list[str] = []
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield made
    finally:
        _scopes.reset(token)


def release_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables; only once nothing reads them any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Sent:
    """An object broadcast to the executors by value, its class included; read ``value`` there."""

    def __init__(self, spark: SparkSession, obj):
        self._raw = spark.sparkContext.broadcast(cloudpickle.dumps(obj))
        self._obj = None

    def __getstate__(self):
        return {"_raw": self._raw, "_obj": None}

    @property
    def value(self):
        if self._obj is None:
            self._obj = pickle.loads(self._raw.value)
        return self._obj


def fold_ascii(text):
    """Lower-case A-Z only; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).take(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; one so small that a single task might read it is dealt to all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
