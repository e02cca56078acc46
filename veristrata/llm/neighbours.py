"""Nearest neighbours by learned partitions: a balanced cut of a neighbour graph, and a classifier that routes queries to likely parts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_batches, materialize

#: Most vectors that the index is fitted on, and how many of them make a part at least; together they bound the parts.
SAMPLE, PART = 8192, 128
#: Neighbours in the graph, and in a result.
DEGREE, NEAREST = 16, 10
#: Share of a sampled vector's neighbours that the parts it is routed to must hold on average.
ROUTED = 0.98
#: Candidates that are ranked at once, and queries beside them.
BLOCK, BESIDE = 8192, 256


# ---------------------------------------------------------------- the graph and its balanced cut


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """The nearest rows of each row, itself left out; by blocks of rows. n by min(degree, n - 1)."""
    n, norms = len(x), (x * x).sum(axis=1)
    degree = min(degree, n - 1)
    out = np.zeros((n, degree), dtype=np.int64)
    for first in range(0, n, 512):
        rows = np.arange(first, min(first + 512, n))
        d = norms[None, :] - 2 * x[rows] @ x.T
        d[np.arange(len(rows)), rows] = np.inf
        if degree:
            found = np.argpartition(d, degree - 1, axis=1)[:, :degree]
            order = np.argsort(np.take_along_axis(d, found, axis=1), axis=1, kind="stable")
            out[rows] = np.take_along_axis(found, order, axis=1)
    return out


def _bisect(members: np.ndarray, x: np.ndarray, near: np.ndarray, share: float) -> np.ndarray:
    """Whether each member goes to the first side, which gets `share` of them; few edges are cut.

    Begins with a cut across the direction of most variance, then swaps equal numbers of vertices that would rather be
    on the other side, those of highest gain first, as long as the cut gets smaller.
    """
    n = len(members)
    centred = x[members] - x[members].mean(axis=0)
    direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
    size = int(round(share * n))
    side = np.zeros(n, dtype=bool)
    side[np.argsort(centred @ direction, kind="stable")[:size]] = True
    place = np.full(len(x), -1, dtype=np.int64)
    place[members] = np.arange(n)
    to = place[near[members]]
    u = np.repeat(np.arange(n), to.shape[1])[to.ravel() >= 0]
    v = to.ravel()[to.ravel() >= 0]
    u, v = np.concatenate([u, v]), np.concatenate([v, u])
    cut = int((side[u] != side[v]).sum())
    for _ in range(30):
        gain = np.bincount(u, weights=np.where(side[u] != side[v], 1.0, -1.0), minlength=n)
        ones, zeros = np.flatnonzero(side), np.flatnonzero(~side)
        ones, zeros = ones[np.argsort(-gain[ones], kind="stable")], zeros[np.argsort(-gain[zeros], kind="stable")]
        m = min(len(ones), len(zeros))
        k = int((gain[ones[:m]] + gain[zeros[:m]] > 0).sum())
        while k:  # all swaps at once may undo one another: then fewer
            new = side.copy()
            new[ones[:k]], new[zeros[:k]] = False, True
            now = int((new[u] != new[v]).sum())
            if now < cut:
                break
            k //= 2
        if not k:
            break
        side, cut = new, now
    return side


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int) -> np.ndarray:
    """The part of each row: 0 to parts - 1, of equal sizes but for rounding, by recursive bisection of the graph."""
    out = np.zeros(len(x), dtype=np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        members, first, k = todo.pop()
        if k == 1:
            out[members] = first
            continue
        side = _bisect(members, x, near, (k // 2) / k)
        todo += [(members[side], first, k // 2), (members[~side], first + k // 2, k - k // 2)]
    return out


# ---------------------------------------------------------------- the classifier


@dataclass
class Router:
    """A network of one hidden layer: the probability of each part for a vector; `width` parts are looked into."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    width: int = 1

    @property
    def parts(self) -> int:
        return len(self.b2)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        z = h @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(x: np.ndarray, near: np.ndarray, part: np.ndarray, parts: int, epochs: int = 40, hidden: int = 128, rate: float = 3e-3) -> Router:
    """Learn which parts hold a vector and its neighbours: cross-entropy with their shares, by Adam in batches of fixed order."""
    rng = np.random.default_rng(7)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1.0)
    goal[np.arange(len(x)), part] += 1 + near.shape[1] / 4
    goal /= goal.sum(axis=1, keepdims=True)
    mean, scale = x.mean(axis=0), float(x.std()) or 1.0
    z = (x - mean) / scale
    w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, s, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(len(x))
        for first in range(0, len(x), 256):
            b = order[first : first + 256]
            a = z[b] @ w[0] + w[1]
            h = np.maximum(a, 0)
            o = h @ w[2] + w[3]
            p = np.exp(o - o.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - goal[b]) / len(b)
            back = (d @ w[2].T) * (a > 0)
            t += 1
            for k, g in enumerate((z[b].T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                w[k] = w[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return Router(mean, scale, *w)


def fit(x: np.ndarray, sample_part: int = PART, routed: float = ROUTED) -> Router:
    """The index of a sample's distinct vectors: graph, balanced parts, router, and how many parts a query looks into.

    A fifth of the vectors is kept from training; the width is the least at which the likeliest parts hold `routed` of
    their nearest, where a vector lies in the part that the router finds likeliest, as it does in the index. Fewer than
    two parts' worth of vectors are one part.
    """
    unit = float(np.abs(x).max(initial=0.0)) or 1.0  # squares of what is left cannot overflow
    x = np.unique(x, axis=0) / unit
    parts = max(1, len(x) // sample_part)
    dims = x.shape[1]
    if parts == 1:
        return Router(np.zeros(dims), 1.0, np.zeros((dims, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    x = x[np.random.default_rng(3).permutation(len(x))]
    own = x[len(x) // 5 :]
    near = neighbour_graph(own, DEGREE)
    router = train(own, near, balanced_parts(own, near, parts), parts)
    p = router(x)
    home, order = p.argmax(axis=1), np.argsort(-p[: len(x) // 5], axis=1, kind="stable")
    wanted = home[neighbour_graph(x, NEAREST)[: len(x) // 5]]
    rank = np.argsort(order, axis=1)  # of each part, for each query
    reached = np.bincount(np.take_along_axis(rank, wanted, axis=1).ravel(), minlength=parts).cumsum() / wanted.size
    router.width = int(np.searchsorted(reached, routed)) + 1
    router.mean, router.scale = router.mean * unit, router.scale * unit
    return router


# ---------------------------------------------------------------- search


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<double>) of rows that take part: no null id, no null, zero or empty vector, no null, infinite or NaN component."""
    v = F.col(vector).cast("array<double>")
    src = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return src.where(finite & F.exists("v", lambda e: e != 0))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dims)


def nearest(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = NEAREST, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row among all other rows, by Euclidean distance.

    The index is fitted on at most `sample` vectors of least hashed id; every row is then put into the part that the
    router finds likeliest, and a query is ranked against all rows of its `width` likeliest parts, and of more, if these
    hold k rows or fewer. Parts are dealt in blocks by hashed id, so neither a large part nor a vector that a third of
    the rows have is in one task, and queries stream past a block: memory is that of BLOCK candidates. Distances are
    computed from the original vectors in double precision; ties go to the smaller id. Rows that repeat an id and its
    vector count once; of an id with several vectors the least counts. Vectors of another length than the commonest
    (the shorter, if two are) cannot be compared and take no part, nor do those that usable() leaves out. An empty
    table gives an empty result; other columns are left out.
    """
    empty = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    marked = vectors.where(F.coalesce(is_query, F.lit(False))).select(F.col(key).cast("long").alias("id")).distinct()
    rows = usable(vectors, key, vector)
    sizes = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if sizes is None:
        return spark.createDataFrame([], empty)
    dims = sizes["dims"]
    rows = rows.where(F.size("v") == dims)
    learned = np.array([r[0] for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()], dtype=np.float64)
    router = fit(learned)

    def place(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(router(_matrix(b.column(1), dims)).argmax(axis=1).astype(np.int32))], names=["id", "v", "part"])

    # one row an id: a partial minimum per id and task, as in any sum
    single = rows.groupBy("id").agg(F.min("v").alias("v"))
    placed = materialize(map_batches(single, place, "id long, v array<double>, part int"), "placed")
    held = np.zeros(router.parts, dtype=np.int64)
    for r in placed.groupBy("part").count().collect():  # one row a part
        held[r["part"]] = r["count"]
    blocks = np.maximum(1, -(-held // BLOCK))

    def route(batches):
        for b in batches:
            if not b.num_rows:
                continue
            order = np.argsort(-router(_matrix(b.column(1), dims)), axis=1, kind="stable")
            enough = (held[order].cumsum(axis=1) <= k).sum(axis=1) + 1
            width = np.minimum(np.maximum(enough, router.width), router.parts)
            row, at = np.nonzero(np.arange(router.parts)[None, :] < width[:, None])
            part = order[row, at]
            row, part = np.repeat(row, blocks[part]), np.repeat(part, blocks[part])
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (part[1:] != part[:-1]))) if len(row) else np.zeros(0, np.int64)
            block = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
            taken = b.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(block.astype(np.int32)), *taken.columns], names=["part", "block", "id", "v"])

    queries = placed.join(marked, "id", "left_semi").select("id", "v")
    asked = map_batches(queries, route, "part int, block int, id long, v array<double>").withColumn("kind", F.lit(1))
    of_part = F.element_at(F.array(*(F.lit(int(n)) for n in blocks)), F.col("part") + 1)
    told = placed.select("part", F.pmod(F.xxhash64("id"), of_part).cast("int").alias("block"), "id", "v", F.lit(0).alias("kind"))
    dealt = told.unionByName(asked).repartition("part", "block").sortWithinPartitions("part", "block", "kind", "id")

    def rank(batches):
        now, ids, cands, waiting = None, [], [], []

        def answers():
            x = np.concatenate(cands) if cands else np.zeros((0, dims))
            found = _ranked(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]), np.concatenate(ids) if ids else np.zeros(0, np.int64), x, k)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

        for b in batches:
            part, block, id_, kind = (np.asarray(b.column(j)) for j in (0, 1, 2, 4))
            v = _matrix(b.column(3), dims)
            change = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (block[1:] != block[:-1]) | (kind[1:] != kind[:-1]))) if len(part) else []
            for a, e in zip(change, np.append(change[1:], len(part)) if len(part) else []):
                if now != (part[a], block[a]):
                    if waiting:
                        yield answers()
                    now, ids, cands, waiting = (part[a], block[a]), [], [], []
                if kind[a] == 0:
                    ids.append(id_[a:e])
                    cands.append(v[a:e])
                else:
                    waiting.append((id_[a:e], v[a:e]))
                    if sum(len(w[0]) for w in waiting) >= BESIDE:
                        yield answers()
                        waiting = []
        if waiting:
            yield answers()

    found = map_batches(dealt.select("part", "block", "id", "v", "kind"), rank, "query_id long, vec_id long, score double")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _ranked(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
    """(query, candidate, distance): the k nearest of ascending ids for each query. Products propose, with room for their rounding; differences decide."""
    if len(ids):
        # of equal vectors the k + 1 least ids are enough: k may be results, one the query itself
        _, same = np.unique(x, axis=0, return_inverse=True)
        order = np.argsort(same, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(same[order]) != 0))
        nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        keep = np.sort(order[nth <= k])
        ids, x = ids[keep], x[keep]
    out = [], [], []
    norms = (x * x).sum(axis=1)
    for first in range(0, len(q), BESIDE):
        block = q[first : first + BESIDE]
        with np.errstate(over="ignore", invalid="ignore"):
            d = norms[None, :] + (block * block).sum(axis=1)[:, None] - 2 * block @ x.T
        d[qid[first : first + BESIDE, None] == ids[None, :]] = np.inf
        for r in range(len(block)):
            room = 1e-9 * (norms.max(initial=0.0) + float(block[r] @ block[r]))
            bound = np.partition(d[r], k - 1)[k - 1] if len(ids) > k else np.inf
            other = ids != qid[first + r]
            near = np.flatnonzero(other & (d[r] <= bound + room) if np.isfinite(bound) else other)  # squares overflow: differences alone
            with np.errstate(over="ignore"):
                exact = np.sqrt(((x[near] - block[r]) ** 2).sum(axis=1))
            best = np.lexsort((ids[near], exact))[:k]
            out[0].extend([qid[first + r]] * len(best))
            out[1].extend(ids[near][best])
            out[2].extend(exact[best])
    return np.array(out[0], np.int64), np.array(out[1], np.int64), np.array(out[2], np.float64)
