"""Embedding near-dedup by an epsilon grid order join.

Unit vectors whose cosine is at least c lie within ``eps = sqrt(2 - 2c)``, and so do their
projections on any orthonormal axes.  Vectors are sorted by the cells (of width eps) of
their leading principal coordinates and cut into blocks of consecutive vectors.  Blocks are
the leaves of a tree of sequence intervals; starting from the root with itself, each level
is one keyed join that replaces a pair of intervals by the pairs of their children whose
boxes are within eps.  Inside a block the sequence is halved again and again along its widest
axis; a pair of blocks goes on only if some of their leaf intervals are within eps, which is
decided on the leaves' boxes alone.  Only the vectors of such leaves are sent, and each leaf is
compared with those near it by one matrix product.  Boxes span the leading axes and the
length of what these leave out, which differs by no more than the vectors do.

Links are never listed: each pair of blocks gives the number of links of each vector and a
spanning forest of the links.  Equal vectors, told by 96 bits of two hashes, are one node that
counts as often as it occurs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing and are their own component; vectors of different lengths don't link;
rows that repeat a vec_id are vectors of their own; a null vec_id names no component; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components, forest
from .storage import narrow, table, tasks, written

COSINE = 0.95
AXES = 32  # leading axes that bound distances
BLOCKS = 2048, 16_384  # fewest and most vectors of a block; fewer where tasks would be idle
LEAF = 32
FAN = 16
SAMPLE = 1 << 23  # components of the vectors that the axes are fitted to; any axes give the same links
_SLACK = 1e-6  # by which rounding may lengthen a gap of boxes
_BLOCKS = "block long, low array<double>, high array<double>, leaves binary, nodes binary, times binary, vectors binary"


def _units(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def axes(vectors: DataFrame, n: int, dim: int) -> np.ndarray:
    """Leading principal axes (columns) of a bounded sample of the vectors, fitted by one task."""
    most = max(256, SAMPLE // dim)
    part = vectors.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 20)) < max(1, int(min(1.0, most / max(1, n)) * (1 << 20)))).select("vector").limit(2 * most)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [_units(np.stack(b.column(0).to_numpy(zero_copy_only=False))) for b in batches if b.num_rows]
        if rows:
            found = np.linalg.eigh(np.cov(np.concatenate(rows).T, bias=True).reshape(dim, dim))[1][:, ::-1][:, :AXES]
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(found).tobytes()], pa.binary())], ["axes"])

    made = part.repartition(1).mapInArrow(fit, "axes binary").head()
    return np.frombuffer(bytes(made[0])).reshape(dim, -1) if made else np.eye(dim)[:, :AXES]


def places(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Coordinates that bound distances: the leading axes, and the length of the rest."""
    p = x @ basis
    return np.column_stack([p, np.sqrt(np.maximum(0.0, 1.0 - (p * p).sum(axis=1)))])


def halved(p: np.ndarray) -> np.ndarray:
    """An order in which every half of every interval, down to LEAF, is compact in its widest axis."""
    order, todo = np.arange(len(p)), [(0, len(p))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo > LEAF:
            own, mid = p[order[lo:hi]], (hi - lo) // 2
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            order[lo:hi] = order[lo:hi][np.argpartition(own[:, axis], mid)]
            todo += [(lo, lo + mid), (lo + mid, hi)]
    return order


def leaf_bounds(n: int) -> list[tuple[int, int]]:
    """The leaf intervals of a sequence of n, in order."""
    out, todo = [], [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo > LEAF:
            todo += [(lo, (lo + hi) // 2), ((lo + hi) // 2, hi)]
        else:
            out.append((lo, hi))
    return sorted(out)


def leaf_boxes(p: np.ndarray) -> np.ndarray:
    """(leaf, 2, axis): least and greatest places of each leaf interval."""
    return np.array([[p[lo:hi].min(axis=0), p[lo:hi].max(axis=0)] for lo, hi in leaf_bounds(len(p))])


def _keys(basis: np.ndarray, eps: float) -> Callable:
    """Adds the grid key: the cells of the leading coordinates, most significant first."""
    side = int(np.ceil(1 / eps)) + 1
    use = max(1, min(basis.shape[1], int(60 / np.log2(2 * side))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = np.stack(batch.column(0).to_numpy(zero_copy_only=False))
                cells = np.clip(np.floor(_units(raw) @ basis[:, :use] / eps).astype(np.int64) + side, 0, 2 * side - 1)
                key = np.zeros(len(raw), dtype=np.int64)
                for k in range(use):
                    key = key * (2 * side) + cells[:, k]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], ["vector", "node", "times", "key"])

    return add


def _blocks(basis: np.ndarray, size_of: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, count, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def block(raw: np.ndarray, nodes: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            p = places(_units(raw), basis)
            order = halved(p)
            p = p[order]
            row = [first + count, p.min(axis=0).tolist(), p.max(axis=0).tolist(), leaf_boxes(p).tobytes(), *(x[order].tobytes() for x in (nodes, times, raw))]
            kinds = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["block", "low", "high", "leaves", "nodes", "times", "vectors"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((np.stack(batch.column(0).to_numpy(zero_copy_only=False)), batch.column(1).to_numpy(), batch.column(2).to_numpy()))
            size += batch.num_rows
            while size >= size_of:
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                yield block(*(x[:size_of] for x in whole))
                held, size, count = [tuple(x[size_of:] for x in whole)], size - size_of, count + 1
        if size:
            yield block(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return cut


def _gap(box: str, other: str) -> str:
    """SQL for the squared distance of two boxes."""
    apart = f"zip_with(zip_with({box}_low, {other}_high, (x, y) -> x - y), zip_with({other}_low, {box}_high, (x, y) -> x - y), (x, y) -> greatest(x, y, 0D))"
    return f"aggregate({apart}, 0D, (s, x) -> s + x * x)"


def block_pairs(blocks: DataFrame, reach: float) -> DataFrame:
    """(s, t), s <= t: pairs of blocks whose boxes are within the distance ``reach``."""
    from pyspark.sql import Window

    boxes = blocks.select("block", "low", "high")
    counts = boxes.groupBy((F.shiftright("block", 32)).alias("part")).count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = counts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    rank = F.col("start") + F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
    leaves = written(narrow(boxes.join(starts, F.shiftright("block", 32) == F.col("part")).select("block", rank.alias("node"), "low", "high")), "leaves")
    levels, n = [leaves.select("node", "low", "high")], leaves.count()
    while n > 1:
        n = -(-n // FAN)
        ends = [F.array(*[f(F.col(side)[k]) for k in range(_width(leaves))]).alias(side) for side, f in (("low", F.min), ("high", F.max))]
        levels.append(written(narrow(levels[-1].groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(*ends)), "level"))
    pairs = levels[-1].select(F.col("node").alias("s"), F.col("node").alias("t"))
    for level in levels[-2::-1]:
        a = level.select(F.col("node").alias("x"), F.floor(F.col("node") / FAN).alias("s"), F.col("low").alias("a_low"), F.col("high").alias("a_high"))
        b = level.select(F.col("node").alias("y"), F.floor(F.col("node") / FAN).alias("t"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
        pairs = written(narrow(pairs.join(a, "s").join(b, "t").where(f"x <= y and {_gap('a', 'b')} <= {reach * reach!r}").select(F.col("x").alias("s"), F.col("y").alias("t"))), "level")
    name = leaves.select("node", "block")
    return pairs.join(name.toDF("s", "a"), "s").join(name.toDF("t", "b"), "t").select("a", "b")


def _width(leaves: DataFrame) -> int:
    first = leaves.select(F.size("low")).head()
    return first[0] if first else 1


def touching(x: np.ndarray, y: np.ndarray, reach: float) -> np.ndarray:
    """Which boxes of x are within reach of which of y."""
    gap = np.zeros((len(x), len(y)))
    for axis in range(x.shape[2]):
        apart = np.maximum(x[:, None, 0, axis] - y[None, :, 1, axis], y[None, :, 0, axis] - x[:, None, 1, axis])
        gap += np.maximum(apart, 0) ** 2
    return gap <= reach * reach


def _screen(reach: float, width: int) -> Callable:
    """Of pairs of blocks (a, b, leaves of each), those with leaves within reach, and which leaves these are."""

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_py()).reshape(-1, 2, width) for c in (2, 3))
                near = touching(x, y, reach)
                if near.any():
                    masks = [np.packbits(near.any(axis=1 - side)).tobytes() for side in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in (0, 1)), *(pa.array([x], pa.binary()) for x in masks)], ["a", "b", "mask_a", "mask_b"])

    return screen


_SENT = "a long, b long, side int, nodes binary, times binary, vectors binary"


def _leaves(dim: int, kind: str) -> Callable:
    """Rows (a, b, side, mask, nodes, times, vectors): a block's vectors in the leaves that the mask names."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                mask, nodes, times, raw = (batch.column(c)[k].as_py() for c in range(3, 7))
                nodes, times, raw = np.frombuffer(nodes, np.int64), np.frombuffer(times, np.int64), np.frombuffer(raw, kind).reshape(-1, dim)
                bounds = leaf_bounds(len(nodes))
                wanted = np.unpackbits(np.frombuffer(mask, np.uint8), count=len(bounds))
                use = np.concatenate([np.arange(lo, hi) for (lo, hi), w in zip(bounds, wanted, strict=True) if w])
                sent = [pa.array([x[use].tobytes()], pa.binary()) for x in (nodes, times, raw)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in range(3)), *sent], ["a", "b", "side", "nodes", "times", "vectors"])

    return cut


def _join(basis: np.ndarray, dim: int, kind: str, cosine: float, reach: float) -> Callable:
    """For each pair of blocks: (node, links) counts, then (node, root) edges of a forest.

    The sides of a pair, or the one of a block with itself, follow one another.  A product in single precision, with the most that its rounding can amount to, rules out
    most pairs of leaves; the others are decided in double precision.
    """
    near, step = cosine - dim * 1.2e-7 - 1e-6, max(1, (1 << 21) // dim)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                nodes, times_of = (np.frombuffer(row[c], np.int64) for c in ("nodes", "times"))
                units, same = _units(np.frombuffer(row["vectors"], kind).reshape(-1, dim)), row["a"] == row["b"]
                if row["side"] == 0:
                    n, times, x = nodes, times_of, units
                if row["side"] == 0 and not same:
                    continue  # its other side comes next
                n2, times2, y = nodes, times_of, units
                links, links2, left, right = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), [], []
                rough, rough2 = x.astype(np.float32), y.astype(np.float32)
                bounds, bounds2 = leaf_bounds(len(x)), leaf_bounds(len(y))
                near_leaves = touching(leaf_boxes(places(x, basis)), leaf_boxes(places(y, basis)), reach)
                if same:
                    near_leaves = np.triu(near_leaves)
                leaf_of = np.repeat(np.arange(len(bounds2)), [hi - lo for lo, hi in bounds2])
                for (i, j), touched in zip(bounds, near_leaves, strict=True):
                    most = touched.mean() > 0.7  # then taking them out costs more than it saves
                    cols = np.arange(len(y)) if most else np.flatnonzero(touched[leaf_of])
                    if same:
                        cols = cols[cols >= i]
                    if not len(cols):
                        continue
                    part = slice(cols[0], cols[-1] + 1) if len(cols) == cols[-1] + 1 - cols[0] else cols
                    guess = rough[i:j] @ rough2[part].T
                    if same:
                        guess[:, : j - i][np.tri(j - i, dtype=bool)] = -1  # each pair once
                    p, q = np.nonzero(guess >= near)
                    if not len(p):
                        continue
                    p, q = p + i, cols[q]
                    hit = np.concatenate([(x[p[k : k + step]] * y[q[k : k + step]]).sum(axis=1) >= cosine for k in range(0, len(p), step)])
                    p, q = p[hit], q[hit]
                    np.add.at(links, p, times2[q])
                    np.add.at(links if same else links2, q, times[p])
                    if len(p):
                        child, root = forest(n[p], n2[q])
                        left.append(root)
                        right.append(child)
                for name, found in ((n, links),) if same else ((n, links), (n2, links2)):
                    if (some := found > 0).any():
                        yield _found(0, name[some], found[some])
                if left:
                    child, root = forest(np.concatenate(left), np.concatenate(right))
                    yield _found(1, root, child)

    return join


def _found(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])


def _of_length(vectors: DataFrame, dim: int, kind: str, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(node, links) and (vertex, component) of nodes whose vectors have ``dim`` components."""
    spark, n, many = vectors.sparkSession, tasks(vectors.sparkSession), vectors.count()
    basis = axes(vectors, many, dim)
    eps = float(np.sqrt(2 - 2 * cosine))
    reach, width = eps + _SLACK, basis.shape[1] + 1
    size = int(np.clip(many / np.sqrt(6 * n), *BLOCKS))  # so that even if all pairs of blocks survive, each task gets a few
    of = f"vector {vectors.schema['vector'].dataType.simpleString()}, node long, times long, key long"
    keyed = vectors.select("vector", "node", "times").mapInArrow(_keys(basis, eps), of)
    parts = max(1, min(n, many // size))
    placed = keyed.repartitionByRange(parts, "key", "node").sortWithinPartitions("key", "node").drop("key")
    blocks = written(placed.mapInArrow(_blocks(basis, size), _BLOCKS), "blocks")
    left, right = (blocks.select(F.col("block").alias(c), F.col("leaves").alias(f"leaves_{c}")) for c in "ab")
    near = block_pairs(blocks, reach).join(left, "a").join(right, "b").select("a", "b", "leaves_a", "leaves_b")
    pairs = written(narrow(near.mapInArrow(_screen(reach, width), "a long, b long, mask_a binary, mask_b binary")), "pairs")
    held = ["nodes", "times", "vectors"]
    left = pairs.join(blocks, pairs["a"] == blocks["block"]).select("a", "b", F.lit(0).alias("side"), F.col("mask_a").alias("mask"), *held)
    right = pairs.where("a <> b").join(blocks, F.col("b") == blocks["block"]).select("a", "b", F.lit(1), "mask_b", *held)
    sent = left.union(right).mapInArrow(_leaves(dim, kind), _SENT).repartition(n, "a", "b").sortWithinPartitions("a", "b", "side")
    found = written(sent.mapInArrow(_join(basis, dim, kind, cosine, reach), "kind int, a long, b long"), "links")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    return counts, components(found.where("kind = 1").select("a", "b"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, n_links, component_id, kept of each row of ``vectors``."""
    item = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = {"float": "f4", "double": "f8"}.get(item)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), (F.col(vector_col) if kind else F.col(vector_col).cast("array<double>")).alias("vector"))
    kind = kind or "f8"
    fine = "vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(vector, x -> x <> 0)"
    keyed = rows.select("id", "vector", *[F.when(F.expr(fine), k).alias(c) for c, k in (("key", F.xxhash64("vector")), ("check", F.hash("vector")))])
    grouped = keyed.where("key is not null").groupBy("key", "check").agg(F.min("id").alias("rep"), F.count("*").alias("times"), F.first("vector").alias("vector"))
    nodes = written(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
    dims = [r[0] for r in nodes.select(F.size("vector")).distinct().collect()]  # one row a length
    counts = components_of = None
    for dim in sorted(dims):
        found = _of_length(nodes.where(F.size("vector") == dim), dim, kind, cosine)
        counts, components_of = found if counts is None else (counts.union(found[0]), components_of.union(found[1]))
    if counts is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    named = nodes.select("key", "check", "node", "rep", "times").join(components_of.withColumnRenamed("vertex", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = named.join(least, "component").join(counts, "node", "left")
    known = known.select("key", "check", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    out = keyed.select("id", "key", "check").join(known, ["key", "check"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def op1_embedding_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
with recursive fine as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from fine a join fine b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.95
), reach as (
  select vec_id as v, vec_id as r from embeddings
  union
  select links.b, reach.r from reach join links on links.a = reach.v
)
select e.vec_id, coalesce(n.n, 0) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join (select v, min(r) as component_id from reach group by v) c on c.v = e.vec_id
left join (select a, count(*) as n from links group by a) n on n.a = e.vec_id
"""
