"""Merkle dataset manifest: events of indexed child digests combine by parent; what is unresolved reshuffles; reverse links give proofs."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_batches, materialize

#: Children of a node, and levels that one round of combining climbs: a group of a round holds at most ARITY ** STEP nodes.
ARITY, STEP = 3, 8


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """The digest of a row: doc_id, source, lang, n_chars and text, each with its length in bytes, or `-` if null."""
    return F.sha2(F.concat(*(_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), _field(text)), 256)


def level_size(n: int, level: int) -> int:
    """Nodes at a level of a tree over n leaves."""
    for _ in range(level):
        n = -(-n // ARITY)
    return n


def height(n: int) -> int:
    return 0 if n <= 1 else 1 + height(-(-n // ARITY))


class Partial:
    """Partial parents of one tree over n leaves: combiners that children reach in any order.

    offer() is an event: a node's digest arrives at its parent's combiner, which keeps digests by slot until it has as
    many as the level's size asks of it; then the parent is a node itself and reaches its own parent, up to the level
    `top`. `links` gets, for each child of a parent that was resolved, what stands left and right of it in the run.
    """

    def __init__(self, n: int, top: int, links: dict | None = None):
        self.height, self.links = height(n), links
        self.top = min(top, self.height)
        self.sizes = [level_size(n, k) for k in range(self.top + 1)]
        self.open: dict[tuple[int, int], dict[int, str]] = {}
        self.done: list[tuple[int, int, str]] = []

    def offer(self, level: int, index: int, value: str) -> None:
        while level < self.top:
            parent, slot = divmod(index, ARITY)
            combiner = self.open.setdefault((level + 1, parent), {})
            combiner[slot] = value
            if len(combiner) < min(ARITY, self.sizes[level] - ARITY * parent):
                return
            run = [combiner[k] for k in range(len(combiner))]
            del self.open[level + 1, parent]
            if self.links is not None:
                for k in range(len(run)):
                    self.links[level, ARITY * parent + k] = "".join(run[:k]), "".join(run[k + 1 :])
            level, index, value = level + 1, parent, digest(*run)
        self.done.append((level, index, value))

    def frontier(self) -> list[tuple[int, int, str]]:
        """Nodes at the top, and those whose parents still wait for others."""
        waiting = [(level - 1, ARITY * parent + slot, v) for (level, parent), combiner in self.open.items() for slot, v in combiner.items()]
        return self.done + waiting


# ---------------------------------------------------------------- numbering


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with `n`, the size of the row's tree, and `i`, its place there by `order` (nulls first), as a table.

    Rows are dealt by ranges of tree and order, so a tree of any size is spread; each range counts its rows by tree, and
    the counts before it are summed over ranges, of which a tree has no more than there are partitions.
    """
    by = [F.col(tree).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    at = dealt.columns.index(tree)

    def count(batches):
        part, now, k = TaskContext.get().partitionId(), (), 0
        for b in batches:
            places = []
            for name in b.column(at).to_pylist():
                if now != (name,):
                    now, k = (name,), 0
                places.append(k)
                k += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(places, pa.int64())], names=[*b.schema.names, "part", "place"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", part int, place long"
    placed = materialize(map_batches(dealt, count, schema), "placed")
    counts = placed.groupBy(tree, "part").agg(F.count("*").alias("rows"))
    of_tree = Window.partitionBy(tree)
    before = F.coalesce(F.sum("rows").over(of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = counts.select(F.col(tree).alias("of"), F.col("part").alias("at"), before.alias("before"), F.sum("rows").over(of_tree).alias("n"))
    out = placed.join(sums, (placed["part"] == sums["at"]) & placed[tree].eqNullSafe(sums["of"]))
    out = materialize(out.select(*rows.columns, "n", (F.col("place") + F.col("before")).alias("i")), "numbered")
    discard(placed)
    return out


# ---------------------------------------------------------------- combining by key

_NODE = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("i", pa.int64()), ("value", pa.string())])
_NODES = "tree string, n long, level int, i long, value string"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _combined(nodes: DataFrame, top: int) -> DataFrame:
    """Events of nodes, partition by partition: ancestors up to level `top` where all children are there, else the children."""

    def run(batches):
        now, combiners, held = None, None, []
        for b in batches:
            for tree, n, level, i, value in zip(*(c.to_pylist() for c in b.columns)):
                block = tree, n, i // ARITY ** (top - level)
                if now != block:
                    if now is not None:
                        held += [(*now[:2], *x) for x in combiners.frontier()]
                    if len(held) > 2000:
                        yield _batch(held, _NODE)
                        held = []
                    now, combiners = block, Partial(n, top)
                combiners.offer(level, i, value)
        if now is not None:
            yield _batch(held + [(*now[:2], *x) for x in combiners.frontier()], _NODE)

    return map_batches(nodes.select("tree", "n", "level", "i", "value"), run, _NODES)


def climb(nodes: DataFrame, base: int) -> DataFrame:
    """combineByKey: nodes of level `base` become their ancestors of level base + STEP, or the roots of lower trees.

    Each partition combines what it has; the unresolved frontier is dealt by ancestor, of at most ARITY ** STEP nodes,
    and combines again. So a large tree is many groups, and only what no partition could resolve alone moves.
    """
    top = base + STEP
    local = _combined(nodes.sortWithinPartitions("tree", "i"), top)
    dealt = local.withColumn("block", F.expr(f"i div cast(pow({ARITY}, {top} - level) AS bigint)")).repartition("tree", "block")
    return materialize(_combined(dealt.sortWithinPartitions("tree", "block", "level", "i"), top), "nodes")


def rounds(leaves: DataFrame) -> list[DataFrame]:
    """Tables of nodes (tree, n, level, i, value): the leaves, then STEP levels up each, until every tree has its root alone."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    out = [leaves]
    for base in range(0, height(most), STEP):
        out.append(climb(out[-1].where((F.col("level") == base) & (F.col("n") > ARITY**base)), base))
    return out


def roots(tables: list[DataFrame]) -> DataFrame:
    """(tree, n, value): each tree's last node. It lies in the first table in which the tree is one node."""
    out = tables[0].where("n = 1").select("tree", "n", "value")
    for k, t in enumerate(tables[1:]):
        ended = (F.col("n") > ARITY ** (STEP * k)) & (F.col("n") <= ARITY ** (STEP * (k + 1)))
        out = out.unionByName(t.where(ended).select("tree", "n", "value"))
    return out


# ---------------------------------------------------------------- reverse links

_PATHS = "tree string, n long, i long, path array<struct<l:string,r:string>>, subroot string"
_STEPS = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
_PATH = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("i", pa.int64()), ("path", _STEPS), ("subroot", pa.string())])


def _descend(nodes: DataFrame, above: DataFrame, base: int, finish, schema: str) -> DataFrame:
    """Give each node of level `base` its siblings up to its ancestor at base + STEP (or its root), then that ancestor's.

    above: the ancestors' paths. finish() makes batches of (row of nodes, path, subroot). A group is the nodes below one
    ancestor, ARITY ** STEP at most; its combiners run again, now for the links from parents to children.
    """
    top, block, steps = base + STEP, F.expr(f"i div {ARITY**STEP}"), above.schema["path"].dataType
    own = [c for c in nodes.columns if c != "level"]
    down = nodes.select(block.alias("block"), F.lit(1).alias("kind"), *own, F.lit(None).cast(steps).alias("path"), F.lit(None).cast("string").alias("subroot"))
    up = above.select(F.col("i").alias("block"), F.lit(0).alias("kind"), *((F.col(c) if c in ("tree", "n") else F.lit(None).cast(nodes.schema[c].dataType)).alias(c) for c in own), "path", "subroot")
    dealt = down.unionByName(up).repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "i")

    def group(over, rows):
        n, links = over["n"], {}
        combiners = Partial(n, top, links)
        for r in rows:
            combiners.offer(base, r["i"], r["value"])
        rest = [(x["l"], x["r"]) for x in over["path"]]
        for r in rows:
            path = [links[level, r["i"] // ARITY ** (level - base)] for level in range(base, combiners.top)]
            yield r, path + rest, over["subroot"]

    def run(batches):
        over, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["kind"] == 1:
                    rows.append(r)
                    continue
                if rows:
                    yield from finish(group(over, rows))
                over, rows = r, []
        if rows:
            yield from finish(group(over, rows))

    return map_batches(dealt, run, schema)


def _passed(found):
    """Paths of nodes between two rounds."""
    yield _batch([(r["tree"], r["n"], r["i"], [{"l": left, "r": right} for left, right in path], subroot) for r, path, subroot in found], _PATH)


def proofs(tables: list[DataFrame], above: DataFrame, finish, schema: str) -> DataFrame:
    """Down the rounds: finish() gets every leaf with its siblings, level by level, from its own run up to the root.

    above: the paths of the trees' roots. A tree joins in at the first round whose nodes are more than its root.
    """
    for k in range(len(tables) - 1, 0, -1):
        base = STEP * k
        higher = F.col("n") > ARITY**base
        here = tables[k].where((F.col("level") == base) & higher)
        found = _descend(here, above.where(higher), base, _passed, _PATHS)
        above = materialize(above.where(~higher).unionByName(found), "paths")
    return _descend(tables[0], above, 0, finish, schema)


# ---------------------------------------------------------------- the manifest

_RESULT = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "proof_sha256", "folded_root"))])


def _folded(found):
    """Of each leaf the digest of its siblings, and the root that the tampered leaf, else the original, folds to."""
    held = []
    for r, path, subroot in found:
        value = r["value"] if r["tampered"] is None else r["tampered"]
        for left, right in path:
            value = digest(left, value, right)
        held.append((r["doc_id"], r["value"], subroot, digest(*(x for pair in path for x in pair)), value))
    yield _batch(held, _RESULT)


def _subroots(found):
    """The paths of the sources' roots, for the trees of the sources."""
    yield _batch([(r["name"], r["rows"], 0, [{"l": left, "r": right} for left, right in path], r["value"]) for r, path, _ in found], _PATH)


def leaves_of(docs: DataFrame) -> DataFrame:
    """(source, doc_id, value, tampered, row) as a table; tampered: the leaf of the text without line ends, where those are to be taken out."""
    chosen = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(F.col("text"), F.lit("\n"))
    without = leaf(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text")).alias("value"), F.when(chosen, without).alias("tampered"))
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")


def _tables(rows: DataFrame, tree: str, order: list[str]) -> list[DataFrame]:
    places = numbered(rows, tree, order)
    extra = [c for c in rows.columns if c not in (tree, "value")]
    return rounds(places.select(F.col(tree).alias("tree"), "n", F.lit(0).alias("level"), "i", "value", *extra))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of docs (doc_id, source, lang, n_chars, text).

    A tree over each source's leaves by doc_id (nulls first, equal ids by leaf, equal rows in any order), and one over
    the sources' roots (null first, then by bytes). Text never moves: a row is digested where it is read. A null value
    has a digest of its own, other than an empty one; a source of one row is its own subroot; a null id is never tampered
    with. An empty table gives an empty result; other columns are left out. A group, in combining and in proofs, is at
    most ARITY ** STEP nodes of one source, so no source is in one task; of nodes only digests and places move.
    """
    leaves = leaves_of(docs)
    trees = _tables(leaves, "source", ["doc_id", "value", "row"])
    discard(leaves)
    sources = roots(trees).select(F.lit("").alias("all"), F.col("tree").alias("name"), F.col("n").alias("rows"), "value")
    tops = _tables(materialize(sources, "subroots"), "all", ["name"])
    found = roots(tops).first()
    root = found["value"] if found else None
    start = tops[0].where("i = 0").select("tree", "n", "i", F.array().cast("array<struct<l:string,r:string>>").alias("path"), F.lit(None).cast("string").alias("subroot"))
    above = materialize(proofs(tops, start, _subroots, _PATHS), "paths")
    out = proofs(trees, above, _folded, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    return out.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))
