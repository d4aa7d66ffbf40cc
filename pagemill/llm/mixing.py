"""Mixing sources to target weights by entropy balancing.

The rates r_d nearest (in relative entropy) to one copy of each document, whose tokens
meet ``sum(r_d * size_d) = target`` for every source, have the form
``r_d = min(cap, exp(lambda_source * size_d))``.  The convex dual in the lambdas is solved by
Newton steps; each step is one aggregation over the (source, size) histogram, which is the
dual's sufficient statistic, and no source reaches the driver.  Rates are rounded
into whole copies from the largest size down, each size making up what the larger ones
left over, so a source misses its target by about half its smallest document at most.

Defined cases: a null text has size 0; rows of a null source form a source of their own,
which comes last; repeated doc_ids are rows of their own; documents of size 0 are taken
once at most and count nothing; an empty table gives an empty table; other columns are
ignored.  Equal inputs give equal copies, whatever the partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import narrow, table, tasks, written

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3.0
WEIGHTS = (5, 2, 1)
_KEYS = ["no_source", "source_key"]
_SALTS = 3  # hex digits of the document's hash that split the ranking within one size


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
    )


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Adds ``target`` to a table of sources with their sizes.

    A source's target is ``min(cap * size, weight * level)`` with the one level at which
    the targets sum to all sizes; that is where resharing the excess by weight ends.
    Only the table of sources is ordered, never the documents.
    """
    ranked = sources.withColumn("place", F.row_number().over(Window.orderBy(*_KEYS)) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "place")
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("level", F.min(F.when(F.col("most") / F.col("weight") > F.col("level"), F.struct(F.col("most") / F.col("weight"), "place", "level"))).over(everything)["level"])
    return ranked.withColumn("target", F.least("most", F.coalesce(F.col("weight") * F.col("level"), F.lit(0.0)))).drop("level", "most")


def rate(tilt: Column, size: Column, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(tilt * size, F.lit(700.0))))


_STATE = [*_KEYS, "source_size", "target", "tilt", "low", "high", "scale", "done"]


def tilts(cells: DataFrame, sources: DataFrame, cap: float = CAP, accuracy: float = 1e-10, rounds: int = 100) -> DataFrame:
    """no_source, source_key, source_size, target, tilt: the dual's solution, found for all sources together.

    Each round is one aggregation of the histogram and one table of a row a source; only
    whether any source goes on reaches the driver.  A Newton step that leaves the bracket
    known to hold the solution is replaced by the bracket's middle, so capped documents,
    where the dual is flat, do no harm.  Sources at their cap tilt without bound.
    """
    full = (F.col("source_size") == 0) | (F.col("target") >= cap * F.col("source_size") * (1 - 1e-12))
    start = F.when(full, F.lit(math.inf)).when(F.col("target") <= 0, F.lit(-math.inf)).otherwise(0.0)
    none = F.lit(None).cast("double")
    state = sources.withColumns({"tilt": start, "low": none, "high": none, "scale": F.col("source_size") / F.greatest(F.lit(1), F.col("n")), "done": full | (F.col("target") <= 0)})
    state = written(narrow(state.select(*_STATE)), "tilts")
    tilt, target = F.col("tilt"), F.col("target")
    r, tokens = rate(tilt, F.col("size"), cap), F.col("n") * F.col("size")
    slope = F.when(r < cap, tokens * F.col("size") * r).otherwise(0.0)
    miss = target - F.col("got")
    close = (F.abs(miss) <= accuracy * target) | F.coalesce(F.col("high") - F.col("low") <= 1e-15 * F.greatest(F.abs("low"), F.abs("high")), F.lit(False))
    low, high = F.when(miss > 0, tilt).otherwise(F.col("low")), F.when(miss > 0, F.col("high")).otherwise(tilt)
    step = F.when(F.col("slope") > 0, tilt + miss / F.col("slope"))
    inside = step.isNotNull() & F.coalesce(step > low, F.lit(True)) & F.coalesce(step < high, F.lit(True))
    middle = F.coalesce((low + high) / 2, 2 * tilt + F.signum(miss) / F.col("scale"))
    for _ in range(rounds):
        if not state.where("not done").limit(1).count():
            break
        sums = cells.join(state.where("not done").select(*_KEYS, "tilt"), _KEYS).groupBy(*_KEYS).agg(F.sum(tokens * r).alias("got"), F.sum(slope).alias("slope"))
        joined = state.join(sums, _KEYS, "left")
        moved = F.when(F.col("done") | close, tilt).when(inside, step).otherwise(middle)
        after = {"tilt": moved, "low": F.when(F.col("done"), F.col("low")).otherwise(low), "high": F.when(F.col("done"), F.col("high")).otherwise(high), "done": F.col("done") | close}
        state = written(narrow(joined.select(*[after.get(c, F.col(c)).alias(c) for c in _STATE])), "tilts")
    return state.select(*_STATE[:5])


_ROUNDED = "no_source boolean, source_key string, size long, n long, copies long"


def _round(cap: float) -> Callable:
    """Copies of the documents of each size of a source, from the largest size down.

    Rows (no_source, source_key, size, n, rate) come by source and falling size; only what
    the sizes before have left over is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, carry = None, 0.0
        for batch in batches:
            copies = []
            for none, key, size, n, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (none, key) != now:
                    now, carry = (none, key), 0.0
                wanted = n * r * size + carry
                k = min(max(math.floor(wanted / size + 0.5), 0), math.floor(cap) * n) if size else n
                carry = wanted - k * size
                copies.append(k)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(copies, pa.int64())], [*_KEYS, "size", "n", "copies"])

    return run


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of each row of ``docs``."""
    rows = written(narrow(sized(docs)), "sizes")
    cells = written(narrow(rows.groupBy(*_KEYS, "size").agg(F.count("*").alias("n"))), "cells")
    sources = cells.groupBy(*_KEYS).agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n"))
    spark = docs.sparkSession
    table_of = tilts(cells, targets(sources, weights, cap), cap)
    fixed = F.when(F.col("tilt") == F.lit(math.inf), F.lit(float(cap))).when(F.col("tilt") == F.lit(-math.inf), F.lit(0.0)).otherwise(rate(F.col("tilt"), F.col("size"), cap))
    rates = cells.join(table_of, _KEYS).select(*_KEYS, "size", "n", fixed.alias("rate"))
    ordered = rates.repartition(tasks(spark), *_KEYS).sortWithinPartitions(*_KEYS, F.desc("size"))
    rounded = ordered.mapInArrow(_round(cap), _ROUNDED)
    rounded = written(narrow(rounded), "copies")

    hashed = rows.withColumn("hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("salt", F.substring("hash", 1, _SALTS))
    cell = [*_KEYS, "size"]
    earlier = Window.partitionBy(*cell).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    salts = hashed.groupBy(*cell, "salt").agg(F.count("*").alias("in_salt")).withColumn("earlier", F.coalesce(F.sum("in_salt").over(earlier), F.lit(0)))
    placed = hashed.withColumn("place", F.row_number().over(Window.partitionBy(*cell, "salt").orderBy("hash", "doc_id")))
    placed = placed.join(salts.drop("in_salt"), [*cell, "salt"]).join(rounded, cell).join(table_of.drop("tilt"), _KEYS)
    base = F.floor(F.col("copies") / F.col("n"))
    copies = (base + (F.col("earlier") + F.col("place") <= F.col("copies") - base * F.col("n")).cast("long")).cast("long")
    return placed.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
