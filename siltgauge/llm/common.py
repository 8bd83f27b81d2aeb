"""What the operators of this subpackage share: durable cuts of lineage, batch helpers, components."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import durable


def column_or_null(df: DataFrame, name: str, kind: str):
    """The column cast to kind, or typed nulls where the frame lacks it."""
    return (F.col(f"`{name}`") if name in df.columns else F.lit(None)).cast(kind)


@lru_cache(1)
def _arrays_apart() -> Callable[[], object]:
    """Has the allocator map arrays of a megabyte or more by themselves, so that freeing one gives it back;
    returns what gives back the rest that is free."""
    libc = ctypes.CDLL(None)
    if not hasattr(libc, "mallopt") or not hasattr(libc, "malloc_trim"):
        return lambda: None
    libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which else rises to the largest array freed so far
    return lambda: libc.malloc_trim(0)


def tidy(run: Callable, last: Callable | None = None) -> Callable:
    """run over a partition's batches, then give memory back: workers live on, and what a task
    kept must not add to what the executor's next operators need."""

    def whole(batches: Iterator) -> Iterator:
        trim = _arrays_apart()
        due = time.monotonic() + 0.5
        for made in run(batches):
            yield made
            del made
            if time.monotonic() > due:
                trim()
                due = time.monotonic() + 0.5
        if last is not None:
            last()
        gc.collect()
        trim()
        pa.default_memory_pool().release_unused()

    return whole


def widen(df: DataFrame, fn: Callable, extra: str, last: Callable | None = None, drop: tuple[str, ...] = (), rows: int = 1000) -> DataFrame:
    """All columns of df and those that fn adds; fn maps a pandas batch to a dict of new columns.

    Columns of df whose names clash with new ones are replaced. last runs when a task ends.
    Columns in drop are only read: they never travel back. Batches are worked through by rows.
    Whole numbers travel as text, as pandas would make those beside a null inexact.
    """
    new = T.StructType.fromDDL(extra)
    kept = [c for c in df.columns if c not in new.fieldNames() and c not in drop]
    whole = {f.name for f in df.schema.fields if f.name in kept and isinstance(f.dataType, T.LongType)}
    base = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in whole else F.col(f"`{c}`") for c in df.columns])
    schema = T.StructType([f for f in base.schema.fields if f.name in kept] + new.fields)

    def run(batches: Iterator):
        for pdf in batches:
            for at in range(0, len(pdf), rows):
                part = pdf.iloc[at : at + rows]
                yield part[kept].assign(**fn(part))

    out = base.mapInPandas(tidy(run, last), schema)
    return out.select(*[F.col(f"`{c}`").cast("long").alias(c) if c in whole else F.col(f"`{c}`") for c in out.columns])


class Table:
    """Open addressing over arrays: whole numbers to whole numbers, -1 where a key is absent."""

    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            lucky = np.nonzero(free)[0][first]
            self.keys[slot[lucky]], self.values[slot[lucky]] = keys[left[lucky]], values[left[lucky]]
            stay = np.ones(len(left), bool)
            stay[lucky] = False
            left, slot = left[stay], slot[stay] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * self.MIX >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        same = found == keys
        out = np.where(same, self.values[slot], -1)
        left = np.nonzero(~same & (found >= 0))[0]
        while len(left):
            slot = slot[left] + 1 & self.mask if len(slot) == len(keys) else slot + 1 & self.mask
            found = self.keys[slot]
            same = found == keys[left]
            out[left[same]] = self.values[slot[same]]
            go = ~same & (found >= 0)
            left, slot = left[go], slot[go]
        return out


    def items(self) -> dict[int, int]:
        some = self.keys >= 0
        return dict(zip(self.keys[some].tolist(), self.values[some].tolist()))


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 64) -> DataFrame:
    """(node, component): the smallest node that each node of an undirected edge list reaches.

    Alternates large-star and small-star steps until nothing changes, so rounds grow with the
    logarithm of the diameter, and each round costs a few shuffles of the edge list. Sums are
    taken before shuffles and the joins are plain equi-joins, whose hot keys AQE splits. Each
    round ends in a durable table.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e = durable(e)
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    was = mark(e)
    if not was[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(most_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lu"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("lu")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("lu"), "m")
        near = large.join(low2, F.col("u") == F.col("lu")).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = durable(near.union(low2.select(F.col("lu").alias("u"), F.col("m").alias("v"))).distinct())
        now = mark(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
