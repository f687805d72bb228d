"""Helpers shared by the operators: tables written between stages, and running totals.

A table that later stages read several times is written as Parquet into the folder that the cluster
shares (``spark.checkpoint.dir``), so a lost executor costs only the tasks that it ran, and the size
of what is read back is known to the optimizer, which then decides about broadcasts by itself.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed value: the white space of all text rules here, space and tab to carriage return.
SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"

T = TypeVar("T")

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables between stages: ``spark.checkpoint.dir`` of the session.

    A local session without that setting, as in tests, gets a temporary folder; any other session
    must set it, since executors cannot see each other's local folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if folder:
        return f"{folder.rstrip('/')}/{app}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_folder.setdefault(app, tempfile.mkdtemp(prefix="llm-"))


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written into the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_caches: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    """Hands memory that is free, but still with this process, back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # only of some C libraries
        trim(0)


def use_cache(name: str, clear: Callable[[], None]) -> None:
    """To be called before a cache of this Python worker is used: empties those of other operators.

    Workers live on from one stage to the next, and so would what all of them have cached.  To be called
    in a function of a module: one within another goes to the workers with copies of what it names.
    """
    others = [c for c in _caches if c != name]
    for other in others:
        _caches.pop(other)()
    if others:
        give_back()
    _caches[name] = clear


def gives_back(run: Callable[[Iterator[T]], Iterator[T]]) -> Callable[[Iterator[T]], Iterator[T]]:
    """For functions of ``mapInPandas``: a worker that waits for its next task keeps no free memory."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[T]) -> Iterator[T]:
        yield from run(batches)
        give_back()

    return wrapped


def packed(df: DataFrame, **keys: str) -> DataFrame:
    """All columns as one, ``row``, with copies of some beside it, so no name can clash."""
    return df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        *[F.col(f"`{c}`").alias(name) for name, c in keys.items()],
    )


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, though ``use`` needs it for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def buckets_for(n_rows: int, per_bucket: int = 2_000, most: int = 4_096) -> int:
    """Into how many pieces a group is cut for `running_start`: more for more rows.

    With 4,096 pieces a group of ten billion rows is summed up in pieces of about 2.4 million.
    """
    return max(1, min(most, -(-n_rows // per_bucket)))


def running_start(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: Column, name: str
) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over earlier rows of the same ``keys``.

    Rows are in the order of ``bucket``, then of ``order``.  Sums are made within buckets first, and
    the few sums of buckets are then added up, so no group has to pass through one task.  ``df`` is
    read twice; neither keys nor bucket may be NULL.
    """
    cut = df.withColumn("_bucket", bucket).withColumn("_value", value.cast("long"))
    first = Window.unboundedPreceding
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(first, -1)
    earlier = F.coalesce(F.sum("_sum").over(by_bucket), F.lit(0))
    sums = (
        cut.groupBy(*keys, "_bucket")
        .agg(F.sum("_value").alias("_sum"))
        .select(*keys, "_bucket", earlier.alias("_earlier"))
    )
    own = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(first, -1)
    return (
        cut.withColumn("_own", F.coalesce(F.sum("_value").over(own), F.lit(0)))
        .join(sums, [*keys, "_bucket"])
        .withColumn(name, F.col("_own") + F.col("_earlier"))
        .drop("_bucket", "_value", "_own", "_earlier")
    )
