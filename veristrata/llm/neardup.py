"""Near duplicates: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import discard, map_batches, materialize
from .graph import connected_components

PERCENT = 75
#: Links are confirmed by other word hashes than those that found them.
CONFIRM = 1


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def sketch(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, k0, k1, n, bands): hashes of the word sequence, size of the shingle set, band hashes of its signature.

    Null, empty and wordless texts have n 0 and no bands; texts of fewer than five words are one shingle; equal texts have
    equal rows but for the id; rows repeat as in docs, and an empty table gives an empty one.
    """

    def run(batches):
        for b in batches:
            n = b.num_rows
            sizes, k0, k1 = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            out = np.zeros((n, shingles.BANDS), np.int64)
            rows, held, size = [], [], 0

            def flush():
                nonlocal rows, held, size
                if held:
                    out[rows] = shingles.bands(shingles.signatures(held))
                rows, held, size = [], [], 0

            for r, pair, found in shingles.keyed_sets_of(b.column(1)):
                sizes[r] = len(found)
                k0[r], k1[r] = np.array(pair, dtype=np.uint64).view(np.int64)
                rows.append(r)
                held.append(found)
                size += len(found)
                if size >= 200_000:
                    flush()
            flush()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * shingles.BANDS), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(k0), pa.array(k1), pa.array(sizes), lists], names=["id", "k0", "k1", "n", "bands"])

    src = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    return map_batches(src, run, f"id {_kind(src, 'id')}, k0 long, k1 long, n long, bands array<long>")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full shingle sets reach the similarity; texts (id, t) holds both sides of each.

    A pair with a null or empty text, or with an id that texts lacks, is not one; an id that has several texts counts if
    any of them does. Pairs that repeat stay repeated; without pairs the result is empty.
    """

    def run(batches):
        for b in batches:
            keep = []
            for (_, x), (_, y) in zip(*(shingles.sets_of(b.column(k), seed=CONFIRM) for k in (2, 3))):
                o = shingles.overlap(x, y)
                keep.append(bool(len(x)) and 100 * o >= PERCENT * (len(x) + len(y) - o))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(texts.select(F.col("id").alias("u"), F.col("t").alias("tu")), "u")
    joined = joined.join(texts.select(F.col("id").alias("v"), F.col("t").alias("tv")), "v")
    return map_batches(joined.select("u", "v", "tu", "tv"), run, f"u {_kind(pairs, 'u')}, v {_kind(pairs, 'v')}")


def _tokens(live: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, n, g, s): a row for each shingle of each text that live (id, n, g) names."""

    def run(batches):
        for b in batches:
            at, held, size = [], [], 0
            for r, found in shingles.sets_of(b.column(3), seed=CONFIRM):
                at.append(np.full(len(found), r, np.int64))
                held.append(found)
                size += len(found)
                if size >= 200_000 or r == b.num_rows - 1:
                    rows = pa.array(np.concatenate(at))
                    yield pa.RecordBatch.from_arrays([*(b.column(k).take(rows) for k in range(3)), pa.array(np.concatenate(held).view(np.int64))], names=["id", "n", "g", "s"])
                    at, held, size = [], [], 0

    kind = _kind(live, "id")
    return map_batches(live.join(texts, "id").select("id", "n", "g", "t"), run, f"id {kind}, n long, g {kind}, s long")


def _prefixes(members: DataFrame, groups: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, n, g, m, at, s): what a prefix-filter join on full sets needs of the classes in bands that hold several groups, centres aside.

    Shingles of one group alone cannot be shared across groups; the rest of a set, m of its n, lies rarest first, and at is
    a shingle's place in that order. With J >= 3/4 and nu <= nv the overlap is at least 3/7 (nu + nv), so at least 6/7 nu
    and 3/4 nv: the first shared shingle is in the first m - ceil(6/7 n) + 1 of u and the first m - ceil(3/4 n) + 1 of v,
    and what follows it in both must suffice.
    """
    rows = materialize(_grouped(members.select("band", "id", "n"), groups), "grouped-members")
    mixed = rows.groupBy("band").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("band")
    mixed = materialize(mixed, "mixed-bands")
    live = materialize(rows.join(mixed, "band", "left_semi").select("id", "n", "g").distinct(), "mixed-classes")
    tokens = materialize(_tokens(live, texts), "tokens")
    wide = materialize(tokens.groupBy("s").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("s", "c"), "wide-shingles")
    sets = tokens.join(wide, "s").groupBy("id", "n", "g").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("x"))
    sets = sets.withColumn("m", F.size("x").cast("long")).where("m >= (3 * n + 3) div 4")
    sets = sets.select("id", "n", "g", "m", F.posexplode(F.expr("slice(x, 1, cast(m - (3 * n + 3) div 4 + 1 AS int))")).alias("at", "e"))
    prefix = materialize(sets.select("id", "n", "g", "m", (F.col("at") + 1).alias("at"), F.col("e.s").alias("s")), "prefixes")
    for t in (rows, mixed, live, tokens, wide):
        discard(t)
    return prefix


def _grouped(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows (with id) and g: the id's group, or the id where it has none."""
    named = groups.select(F.col("node").alias("id"), F.col("component").alias("__g"))
    return rows.join(named, "id", "left").withColumn("g", F.coalesce("__g", "id")).drop("__g")


_ENOUGH = "(nu < nv OR nu = nv AND u < v) AND 4 * nu >= 3 * nv AND 7 * (1 + least(lu, lv)) >= 3 * (nu + nv)"


def _sides(prefix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The prefixes as they count for the smaller and for the larger set of a pair."""
    u = prefix.where("at <= m - (6 * n + 6) div 7 + 1").select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("g").alias("gu"), (F.col("m") - F.col("at")).alias("lu"), "s")
    v = prefix.select(F.col("id").alias("v"), F.col("n").alias("nv"), "g", (F.col("m") - F.col("at")).alias("lv"), "s")
    return u, v


def _all_pairs(prefix: DataFrame) -> DataFrame:
    """Every pair across groups that may reach the similarity. Groups meet by shingle before their members do, so pairs within a group are never made."""
    u, v = _sides(prefix)
    of = v.groupBy("s", "g").agg(F.min("nv").alias("least"), F.max("nv").alias("most"), F.max("lv").alias("left"))
    met = u.join(of, "s").where("g <> gu AND nu <= most AND 4 * nu >= 3 * least AND 7 * (1 + least(lu, left)) >= 3 * (nu + greatest(nu, least))").drop("least", "most", "left")
    return met.join(v, ["s", "g"]).where(_ENOUGH).select("u", "v").distinct()


def components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of docs.

    1. Rows with one word sequence are one class, stood for by its least id (a partial minimum, so a text that
       fills a third of the table costs one row per task).
    2. Each class has a SuperMinHash signature of 127 slots in 31 bands of 4: texts at 0.75 share no band with
       probability 8e-6. A band that several classes share links each of them to one, its centre: a star, never all
       pairs. The centre is the member that meets most classes over all its bands: of a text and its near copies that
       is the text itself, which they resemble more than each other.
    3. Stars are confirmed on the full sets and grouped.
    4. What is left is links between members of a band, none its centre, that are still in different groups. A
       prefix-filter join on full sets finds all of them, however few of a band's pairs are similar.
    Links of a band are thus whole: no cap, draw or turn decides which pairs are tested.
    Ids of all rows, links and groups stay in tables; nothing is collected. Null and empty texts have an empty
    set and are linked with nothing. Ids may be of any type that has an order. Rows that repeat an id are copies of one
    document. A null id stands for no class: such a row gets the component of an equal text with an id, or else null
    and kept = true. An empty table gives an empty result. Other columns are not touched.
    """
    # the large joins are sort-merge joins at every size: nothing that grows is broadcast below a threshold
    src = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    base = materialize(sketch(src, "id", "t"), "sketches")
    # only sequences that repeat are joined; as a table of their own, so that the join can split a hot one
    again = base.where("n > 0").groupBy("k0", "k1").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1")
    least = materialize(again.select("k0", "k1", "rep"), "repeated")
    rep = F.coalesce("rep", "id")
    classes = base.join(least.hint("merge"), ["k0", "k1"], "left").select("id", "n", rep.alias("rep"), F.when((F.col("n") > 0) & (F.col("id") == rep), F.col("bands")).alias("bands"))
    classes = materialize(classes, "classes")
    discard(base)
    discard(least)

    reps = classes.where("bands IS NOT NULL")
    rows = reps.select("id", "n", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("band", "size")
    shared = materialize(shared, "shared-bands")
    together = materialize(rows.join(shared.hint("merge"), "band").distinct(), "band-members")
    meets = materialize(together.groupBy("id").agg(F.sum("size").alias("meets")), "meets")
    ranked = materialize(together.join(meets, "id").select("band", "id", "n", "meets"), "ranked-members")
    centres = ranked.groupBy("band").agg(F.max_by(F.struct("id", "n"), F.struct("meets", "id")).alias("c"))
    centres = materialize(centres.select("band", F.col("c.id").alias("v"), F.col("c.n").alias("nv")), "centres")
    around = materialize(ranked.join(centres, "band").where("id <> v").select("band", "id", "n", "v", "nv"), "stars-of-bands")
    for t in (shared, together, meets, ranked, centres):
        discard(t)
    members = around.select("band", "id", "n")
    # sizes alone rule out the rest: the smaller set is at least PERCENT of the larger
    near = around.where(100 * F.least("n", "nv") >= PERCENT * F.greatest("n", "nv"))
    stars = materialize(near.select(F.col("id").alias("u"), "v").distinct(), "stars")
    needed = members.select("id").unionByName(stars.select(F.col("v").alias("id"))).distinct()
    texts = materialize(src.join(needed.hint("merge"), "id", "left_semi"), "candidate-texts")
    links = materialize(verify(stars, texts), "links")
    groups = connected_components(links)
    prefix = _prefixes(members, groups, texts)
    more = materialize(verify(_all_pairs(prefix), texts), "links")
    for t in (around, stars, prefix, texts):
        discard(t)
    if not more.isEmpty():
        discard(groups)
        groups = connected_components(links.unionByName(more))
    out = classes.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.coalesce("component", "rep")
    out = materialize(out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept")), "components")
    for t in (classes, groups, links, more):
        discard(t)
    return out
