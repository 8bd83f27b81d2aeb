"""Near-duplicate vectors by cover trees, and exact top-k search by columnar branch-and-bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column_or_null, components, durable

# --- vectors as bytes -------------------------------------------------------------------


def _usable(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, values, usable) of an array column; null vectors, null or non-finite components are not."""
    offsets = np.asarray(col.offsets.to_numpy(zero_copy_only=False), np.int64)
    values = np.asarray(col.values.to_numpy(zero_copy_only=False), np.float64)
    odd = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    good = odd[offsets[1:]] == odd[offsets[:-1]]
    return offsets, values, good & np.asarray(col.is_valid().to_numpy(zero_copy_only=False), bool)


def _pack(df: DataFrame, integer: bool) -> DataFrame:
    """vec_id, label (text) and the vector as bytes, doubles or floor(64 x) as longs; null if unusable."""
    slim = df.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, val, ok = _usable(b.column(2))
            val = np.where(np.isfinite(val), val, 0.0) + 0.0  # -0.0 becomes 0.0
            raw = (np.floor(64.0 * val).astype("<i8") if integer else val.astype("<f8")).tobytes()
            data = [raw[8 * s : 8 * e] if k else None for s, e, k in zip(off[:-1].tolist(), off[1:].tolist(), ok.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], ["vec_id", "label", "vec"])

    return slim.mapInArrow(run, "vec_id long, label string, vec binary")


def _table(df: DataFrame, vec_id: str, embedding: str, label: str | None) -> DataFrame:
    tag = column_or_null(df, label, "string") if label else F.lit(None).cast("string")
    return df.select(column_or_null(df, vec_id, "long").alias("vec_id"), tag.alias("label"), F.col(f"`{embedding}`").alias("embedding"))


# --- near duplicates --------------------------------------------------------------------


class Node:
    """A ball: centre, radius that covers all its points, and nested balls of half the net's radius."""

    __slots__ = ("centre", "radius", "points", "kids")

    def __init__(self, centre: int, radius: float, points: np.ndarray, kids: list):
        self.centre, self.radius, self.points, self.kids = centre, radius, points, kids


LEAF = 32


def cover_tree(x: np.ndarray, points: np.ndarray, scale: float = 2.0) -> Node:
    """Nested nets of halving radii over unit vectors; distances are Euclidean."""
    centre = int(points[0])
    far = np.sqrt(np.maximum(0.0, 2 - 2 * (x[points] @ x[centre])))
    radius = float(far.max()) + 1e-9
    node = Node(centre, radius, points, [])
    while scale >= radius and scale > 1e-3:
        scale /= 2
    if len(points) <= LEAF or scale <= 1e-3:
        return node
    rest = points
    while len(rest):
        near = x[rest] @ x[rest[0]] >= 1 - scale * scale / 2
        near[0] = True
        node.kids.append(cover_tree(x, rest[near], scale))
        rest = rest[~near]
    return node


def dual(x: np.ndarray, y: np.ndarray, a: Node, b: Node, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(points of a, points of b, which pairs are linked) for all ball pairs that may hold a link.

    With same, x is y and each pair of balls comes once.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-7
    todo = [([a], [b], same)]
    while todo:
        left, right, own = todo.pop()
        ca, cb = np.array([n.centre for n in left]), np.array([n.centre for n in right])
        ra, rb = np.array([n.radius for n in left]), np.array([n.radius for n in right])
        gap = np.sqrt(np.maximum(0.0, 2 - 2 * (x[ca] @ y[cb].T)))
        near = gap <= ra[:, None] + rb[None, :] + reach
        if own:
            near &= np.tri(len(left), dtype=bool).T
        for i, j in np.argwhere(near).tolist():
            p, q = left[i], right[j]
            me = own and i == j
            if not p.kids and not q.kids or len(p.points) * len(q.points) <= 4096:
                hit = x[p.points] @ y[q.points].T >= least
                if me:
                    hit &= ~np.tri(len(p.points), dtype=bool)
                if hit.any():
                    yield p.points, q.points, hit
            elif me:
                todo.append((p.kids, p.kids, True))
            elif p.kids and (not q.kids or p.radius >= q.radius):
                todo.append((p.kids, [q], False))
            else:
                todo.append(([p], q.kids, False))


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def spanning(hit: np.ndarray) -> Iterator[tuple[int, int]]:
    """(row, column) edges that connect whatever the true entries connect."""
    rows_left = hit.any(1)
    cols_left = hit.any(0)
    while rows_left.any():
        rows = np.array([int(rows_left.argmax())])
        rows_left[rows] = False
        while len(rows):
            reach = hit[rows][:, cols_left]
            cols = np.nonzero(cols_left)[0][reach.any(0)]
            for c, r in zip(cols.tolist(), rows[reach[:, reach.any(0)].argmax(0)].tolist()):
                yield r, c
            cols_left[cols] = False
            if not len(cols):  # these rows' columns were reached before
                break
            more = hit[:, cols] & rows_left[:, None]
            new = np.nonzero(more.any(1))[0]
            for r, c in zip(new.tolist(), cols[more[new].argmax(1)].tolist()):
                yield r, c
            rows_left[new] = False
            rows = new


def near_vectors(df: DataFrame, least: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", shard_rows: int = 4096) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept; links hold within equal labels only.

    Equal vectors of a label are made one first and counted by number. A label's vectors are
    dealt into shards of at most about shard_rows, and each pair of shards is one task's work:
    a cover tree of each and a dual traversal that prunes ball pairs. Tasks return numbers of
    links and spanning edges, never all pairs.

    Defined cases: vectors that are null, zero, or hold null or non-finite components, and null
    labels, link with nothing; vectors of different lengths never link; each row is a vector of its
    own, so that repeated rows are copies that link and rows that only share a vec_id are told
    apart; a null vec_id has a component of its own; other columns are left out.
    """
    packed = durable(_pack(_table(df, vec_id, embedding, label), False))
    solid = packed.where("vec IS NOT NULL AND label IS NOT NULL AND translate(hex(vec), '0', '') <> ''")  # zeros are no direction
    reps = durable(solid.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("times")).withColumn("node", F.monotonically_increasing_id()))
    sizes = reps.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("long").alias("shards"))
    dealt = reps.join(sizes, "label").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("shards")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))
    dealt = dealt.select("label", "node", "times", "vec", "mine", other.alias("other"))
    dealt = dealt.select("label", "node", "times", "vec", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def pairs(key, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = key[1], key[2]
        out = []
        pdf = pdf.assign(dim=pdf["vec"].map(len)).sort_values("node")
        for _, part in pdf.groupby("dim"):
            x = np.frombuffer(b"".join(part["vec"]), "<f8").reshape(len(part), -1)
            norm = np.sqrt((x * x).sum(1))
            big = np.abs(x).max(1)
            rescaled = (norm == 0) | ~np.isfinite(norm)
            if rescaled.any():  # squares that under- or overflow
                z = x[rescaled] / np.where(big[rescaled] > 0, big[rescaled], 1)[:, None]
                x = x.copy()
                x[rescaled], norm[rescaled] = z, np.sqrt((z * z).sum(1))
            ok = norm > 0
            part, x = part[ok], x[ok] / norm[ok, None]
            node, times, mine = part["node"].to_numpy(), part["times"].to_numpy(), part["mine"].to_numpy()
            if not len(part):
                continue
            links, union, edges = np.zeros(len(part), np.int64), Union(len(part)), []
            first, second = np.nonzero(mine == i)[0], np.nonzero(mine == j)[0]
            if not len(first) or not len(second):
                continue
            a = cover_tree(x, first)
            b = a if i == j else cover_tree(x, second)
            for p, q, hit in dual(x, x, a, b, least, i == j):
                links[p] += hit @ times[q]
                links[q] += times[p] @ hit
                for r, c in spanning(hit):
                    if union.join(int(p[r]), int(q[c])):
                        edges.append((int(node[p[r]]), int(node[q[c]])))
            some = np.nonzero(links)[0]
            out += [(int(node[k]), int(links[k]), None) for k in some.tolist()] + [(a_, 0, b_) for a_, b_ in edges]
        return pd.DataFrame({"node": pd.array([o[0] for o in out], "Int64"), "links": pd.array([o[1] for o in out], "Int64"), "to": pd.array([o[2] for o in out], "Int64")})

    found = durable(dealt.groupBy("label", "i", "j").applyInPandas(pairs, "node long, links long, to long"))
    links = found.where("to IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.where("to IS NOT NULL").select(F.col("node").alias("a"), F.col("to").alias("b")))
    named = reps.join(links, "node", "left").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = named.join(named.groupBy("component").agg(F.min("rep").alias("low")), "component")
    named = named.select(F.col("label").alias("g_label"), F.col("vec").alias("g_vec"), "times", F.coalesce("links", F.lit(0)).alias("links"), "low")
    rows = packed.join(named, (F.col("label") == F.col("g_label")) & (F.col("vec") == F.col("g_vec")), "left")
    n = F.when(F.col("times").isNull(), F.lit(0)).otherwise(F.col("times") - 1 + F.col("links")).cast("long")
    comp_id = F.coalesce(F.when(F.col("vec_id").isNotNull(), F.col("low")), F.col("vec_id"))
    return rows.select("vec_id", n.alias("n_links"), comp_id.alias("component_id"), (F.col("vec_id") == comp_id).alias("kept"))


# --- exact top-k ------------------------------------------------------------------------


def _masses(m: np.ndarray) -> np.ndarray:
    """Norm of what each row has from each dimension on; one column more than dimensions."""
    out = np.zeros((m.shape[0], m.shape[1] + 1))
    np.cumsum((m.astype(np.float64) ** 2)[:, ::-1], axis=1, out=out[:, 1:])
    return np.sqrt(out[:, ::-1])


def search_block(
    queries: np.ndarray, own: np.ndarray, bound: np.ndarray, rows: np.ndarray, row: np.ndarray, ids: np.ndarray, k: int, step: int = 4, batch: int = 128, shares: list | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the query, place of the row, score) of the k best rows for each query; exact.

    own and row tell which row a query is itself, bound is a score that k of its rows reach for
    certain, or -inf. Dimensions that hold most mass come first, and rows are kept dimension by
    dimension. Partial products grow by ``step`` dimensions. What the rest can add or take away is
    at most the product of the remaining masses: that raises each query's bound, and the pairs that
    can't reach it leave. When fewer than half are left, they are kept as a list, query by query.
    shares, if given, gets the part of all pairs that is left after each block.
    """
    n, d = rows.shape
    if not n or not len(queries):
        return
    peak = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, d)
    kind = np.float64 if peak < 2.0**53 else np.int64  # doubles hold these sums exactly
    first = np.argsort(-(rows.astype(np.float64) ** 2).mean(0) * (queries.astype(np.float64) ** 2).mean(0), kind="stable")
    columns, queries = np.ascontiguousarray(rows[:, first].T.astype(kind)), queries[:, first].astype(kind)
    rest_rows, slack = np.ascontiguousarray(_masses(rows[:, first]).T), 1e-6 + peak * 1e-15
    for at in range(0, len(queries), batch):
        q, mine, least = queries[at : at + batch], own[at : at + batch], bound[at : at + batch].astype(np.float64).copy()
        rest = _masses(q)
        part, left = np.zeros((len(q), n), kind), None
        other = mine[:, None] != row[None, :]
        for c in range(0, d, step):
            e = min(c + step, d)
            if left is None:
                part += q[:, c:e] @ columns[c:e]
                room = rest[:, e, None] * rest_rows[e][None, :] * (1 + 1e-9) + slack
                sure = np.where(other, part - room, -np.inf)
                if n > k and 2 * e >= d:
                    least = np.maximum(least, np.partition(sure, n - k, axis=1)[:, n - k])
                keep = other & (part + room >= least[:, None])
                if shares is not None:
                    shares.append((e, keep.mean()))
                if 2 * keep.sum() < keep.size:
                    left = np.nonzero(keep)
                    score = part[left]
            else:
                i, j = left
                for x in range(c, e):
                    score += q[i, x] * columns[x, j]
                keep = score + rest[i, e] * rest_rows[e, j] * (1 + 1e-9) + slack >= least[i]
                left, score = (i[keep], j[keep]), score[keep]
                if shares is not None:
                    shares.append((e, len(score) / (len(q) * n)))
        if left is None:
            left = np.nonzero(other & (part + slack >= least[:, None]))
            score = part[left]
        i, j = left
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i, "left")
        yield at + i[nth < k], j[nth < k], score[nth < k].astype(np.int64)


def _longs(vecs, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(vecs), "<i8").reshape(len(vecs), size) if len(vecs) else np.zeros((0, size), np.int64)


def _first_bounds(asked: DataFrame, packed: DataFrame, k: int, sample_rows: int) -> DataFrame:
    """asked with bound: a score that k rows of a sample reach, so that k of all rows do.

    The sample, at most twice ``sample_rows`` rows, holds the rows with most mass, which win most
    often, and rows picked by hash. It only starts the bounds, so it changes work, not results.
    """

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(mass=[float((np.frombuffer(v, "<i8").astype(np.float64) ** 2).sum()) for v in pdf["vec"]])

    heavy = packed.select("r", "vec").mapInPandas(weigh, "r long, vec binary, mass double").orderBy(F.desc("mass"), "r").limit(sample_rows).collect()
    mixed = packed.select("r", "vec").orderBy(F.xxhash64("vec"), "r").limit(sample_rows).collect()
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    every = {x["r"]: bytes(x["vec"]) for x in [*heavy, *mixed]}
    for size in {len(v) // 8 for v in every.values()}:
        some = [r for r, v in every.items() if len(v) == 8 * size]
        by_size[size] = np.array(some), _longs([every[r] for r in some], size).T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bound = np.full(len(pdf), -np.inf)
            sizes = pdf["vec"].map(len).to_numpy(np.int64) // 8
            for size in np.unique(sizes).tolist():
                if size not in by_size:
                    continue
                rows, columns = by_size[size]
                at = np.nonzero(sizes == size)[0]
                scores = (_longs(pdf["vec"].iloc[at].tolist(), size) @ columns).astype(np.float64)
                scores[pdf["r"].to_numpy()[at][:, None] == rows[None, :]] = -np.inf
                if len(rows) > k:
                    bound[at] = np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k]
            yield pdf.assign(bound=bound)

    return asked.mapInPandas(run, "r long, vec_id long, vec binary, bound double")


def top_k(df: DataFrame, every: int = 20, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = 8192, group_rows: int = 4096, sample_rows: int = 1024) -> DataFrame:
    """The k rows with the highest integer inner product for each query (vec_id divisible by ``every``).

    Columns query_id, rank, vec_id, score. The queries in groups meet the rows in shards, so that
    a task holds one group and one shard whatever the table's size, and returns k rows a query.

    Defined cases: vectors that are null, or hold null or non-finite components, and null
    vec_ids take no part; vectors of different lengths are never compared; each row is a row of
    its own, so that rows that repeat a vec_id are candidates each, and each query row among them
    has a list of its own, without itself; columns with clashing names are left out; sums beyond a
    long are outside what is defined.
    """
    usable = _pack(_table(df, vec_id, embedding, None), True).where("vec IS NOT NULL AND vec_id IS NOT NULL")
    packed = durable(usable.select(F.monotonically_increasing_id().alias("r"), "vec_id", "vec"))
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    total, asked = packed.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    shards, groups = max(1, -(-total // shard_rows)), max(1, -(-asked // group_rows))
    deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), F.col("r")), F.lit(n)).cast("long")
    over = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = durable(_first_bounds(packed.where(is_query), packed, k, sample_rows))
    q = q.select("r", "vec_id", "vec", "bound", deal(1, groups).alias("g"), over(shards).alias("s"))
    c = packed.select("r", "vec_id", "vec", deal(2, shards).alias("s"), over(groups).alias("g"))

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        size_q, size_c = left["vec"].map(len), right["vec"].map(len)
        for size in sorted({*size_q} & {*size_c}):
            a, b = left[size_q == size], right[size_c == size]
            ids, rows_a = b["vec_id"].to_numpy(), a["r"].to_numpy()
            found = search_block(_longs(a["vec"].tolist(), size // 8), rows_a, a["bound"].to_numpy(), _longs(b["vec"].tolist(), size // 8), b["r"].to_numpy(), ids, k)
            for i, j, score in found:
                out.append(pd.DataFrame({"r": rows_a[i], "query_id": a["vec_id"].to_numpy()[i], "vec_id": ids[j], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"r": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")

    best = q.groupBy("g", "s").cogroup(c.groupBy("g", "s")).applyInPandas(meet, "r long, query_id long, vec_id long, score long")
    order = Window.partitionBy("r").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
