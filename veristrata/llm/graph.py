"""Connected components of an edge table, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node that it reaches.

    Alternates large-star and small-star steps over distinct edges, each with one pre-aggregated minimum per node, until
    the edges no longer change: O(log n) rounds in practice. A hot node's neighbours are never gathered: its minimum is a
    partial aggregate, and minima are a table of their own, so that adaptive execution can split its edges in the join.
    Nulls in src or dst are ignored, self loops give their node alone, repeated edges count once; an empty table gives an
    empty result. Each step's edges are a table in the shared folder; the one before is deleted. The result is such a
    table too, for the caller to discard.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    loops = e.where("u = v").select("u").distinct()
    loops = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
    now = materialize(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        large = _large_star(now)
        discard(now)
        now = _small_star(large)
        discard(large)
        state = _state(now)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components did not settle")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    out = materialize(found.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component")), "components-of-edges")
    discard(now)
    return out


def _state(edges: DataFrame) -> tuple:
    """Number of edges and an order-free checksum; equal after a round only if nothing moved."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return row[0], row[1], row[2]


def _large_star(e: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its least neighbour (or itself)."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _kept(out, least)


def _small_star(e: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the least of them. Here all edges have u > v."""
    least = materialize(e.groupBy("u").agg(F.min("v").alias("m")), "least")
    links = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return _kept(links.unionByName(own), least)


def _kept(edges: DataFrame, least: DataFrame) -> DataFrame:
    out = materialize(edges.where("u <> v").distinct(), "edges")
    discard(least)
    return out
