"""Mixing sources to target weights by Poisson replication. DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spare

#: Beyond this tail the inverted distribution has no more mass than a double's rounding.
TAIL = 1e-15
#: A larger mean is a sum of equal means up to this one, each inverted at a hash of its own.
LARGEST = 500


def poisson_cdf(rate: float) -> list[float]:
    """P(count <= k) for k = 0, 1, ... until the rest is under TAIL."""
    if not 0 <= rate <= LARGEST:
        raise ValueError(f"a mean repetition rate lies between 0 and {LARGEST}")
    out, p, total, k = [], math.exp(-rate), 0.0, 0
    while True:
        total += p
        out.append(total)
        if k >= rate and 1 - total < TAIL or k > 10 * rate + 100:
            return out
        k += 1
        p *= rate / k


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of md5(seed:key); SQL engines agree on it."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float], total: float | None, source: str) -> dict[str | None, float]:
    """Mean repetitions by source; None stands for all sources without a weight of their own ("*"), and for null ones.

    An empty table gives rates of 0; rows that repeat count each.

    The counts come from one aggregate with as many rows as there are weights, whatever the corpus holds.
    """
    named = [k for k in weights if k != "*"]
    group = F.when(F.col(source).isin(named), F.col(source)) if named else F.lit(None).cast("string")
    counts = {r[0]: r[1] for r in docs.groupBy(group.alias("g")).count().collect()}
    whole = sum(weights[k] for k in named if counts.get(k)) + (weights.get("*", 0.0) if counts.get(None) else 0.0)
    size = float(sum(counts.values())) if total is None else float(total)
    out: dict[str | None, float] = {}
    for key in [*named, None]:
        n, w = counts.get(key, 0), weights.get("*" if key is None else key, 0.0)
        out[key] = size * (w / whole) / n if n and whole else 0.0
    return out


def mix(
    docs: DataFrame,
    weights: dict[str, float],
    total: float | None = None,
    seed: int = 0,
    source: str = "source",
    key: str = "doc_id",
    copy: str = "copy",
    partitions: int | None = None,
) -> DataFrame:
    """Repeat each row Poisson(rate of its source) times and deal the copies out in a hash-random order.

    weights: target share by source; "*" is the share of all other sources (and null sources) together. Shares
    need not sum to 1; those of absent sources go to the rest in proportion. total: expected rows of the result
    (the input's size by default). A row's count inverts the Poisson distribution at a number hashed from seed
    and key, so it depends on neither partitioning nor order: a lost task repeats the same copies. A mean over
    LARGEST (a rare source with a large share) is split: a sum of independent Poisson counts is a Poisson count. Equal keys
    get equal counts; a null key hashes as the empty text. A count of 0 leaves the row out (that is the method).
    Adds the long column `copy` (1, 2, ... within a row; it replaces a column of that name). An empty table
    gives an empty one. The global shuffle is by a hash of key and copy, so a hot source has no partition of its own.
    """
    lam = rates(docs, weights, total, source)
    names = [c for c in docs.columns if c != copy]
    kept = [F.col(f"`{c}`") for c in names]
    hashed, count, order = (spare(docs, c) for c in ("__u", "__n", "__order"))
    name_of = F.coalesce(F.col(key).cast("string"), F.lit(""))

    def inverted(rate: float) -> Column:
        times = max(1, math.ceil(rate / LARGEST))
        cdf = F.array(*[F.lit(p) for p in poisson_cdf(rate / times)])
        below = lambda u: F.size(F.filter(cdf, lambda c: c <= u))
        if times == 1:
            return below(F.col(hashed))
        each = F.sequence(F.lit(1), F.lit(times))
        return F.aggregate(each, F.lit(0), lambda n, i: n + below(unit_hash(F.concat(name_of, F.lit(":"), i.cast("string")), seed)))

    n = None
    for name, rate in lam.items():
        if name is not None:
            n = F.when(F.col(source) == name, inverted(rate)) if n is None else n.when(F.col(source) == name, inverted(rate))
    n = inverted(lam[None]) if n is None else n.otherwise(inverted(lam[None]))
    copies = (
        docs.select(*kept, unit_hash(name_of, seed).alias(hashed))
        .select(*kept, n.alias(count))
        .where(F.col(count) > 0)
        .select(*kept, F.explode(F.sequence(F.lit(1).cast("long"), F.col(count).cast("long"))).alias(copy))
    )
    dealt = copies.withColumn(order, F.xxhash64(F.lit(seed), name_of, F.col(copy)))
    dealt = dealt.repartition(partitions, order) if partitions else dealt.repartition(order)
    return dealt.sortWithinPartitions(order).drop(order)
