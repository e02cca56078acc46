"""op12: the manifest against trees built in memory, in any number of rounds."""

import hashlib
import random
import zlib

import pytest

from veristrata.llm import merkle
from veristrata.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """The root, and what stands left and right of each leaf's ancestors."""
    paths, level = [[] for _ in leaves], [(v, [k]) for k, v in enumerate(leaves)]
    while len(level) > 1:
        above = []
        for j in range(0, len(level), 3):
            run = level[j : j + 3]
            for k, (_, below) in enumerate(run):
                for m in below:
                    paths[m].append(("".join(x[0] for x in run[:k]), "".join(x[0] for x in run[k + 1 :])))
            above.append((h(*(x[0] for x in run)), [m for x in run for m in x[1]]))
        level = above
    return level[0][0], paths


def brute(rows):
    leaves = [leaf_of(r, r["text"]) for r in rows]
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own, subroots = {}, []
    for s in names:
        at = sorted((k for k, r in enumerate(rows) if r["source"] == s), key=lambda k: (rows[k]["doc_id"] is not None, rows[k]["doc_id"] or 0, leaves[k]))
        root, paths = tree([leaves[k] for k in at])
        subroots.append(root)
        own |= {k: p for k, p in zip(at, paths)}
    root, upper = tree(subroots)
    out = []
    for k, r in enumerate(rows):
        s = names.index(r["source"])
        path, value = own[k] + upper[s], leaves[k]
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None:
            value = leaf_of(r, r["text"].replace("\n", ""))
        for left, right in path:
            value = h(left, value, right)
        out.append((r["doc_id"], leaves[k], subroots[s], root, h(*(x for p in path for x in p)), value, value == root))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_equals_trees_in_memory(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    found = got(QUERIES["op12_merkle_manifest"](spark, DATA))
    assert found == brute(rows)
    assert {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("step", [1, 2, 8])
def test_odd_rows_in_several_rounds(spark, monkeypatch, step):
    """Nulls in any column, repeated ids and rows, a hot source, sources of one row, a clashing column; trees of up to five levels."""
    monkeypatch.setattr(merkle, "STEP", step)
    rnd = random.Random(step)
    rows = [(rnd.choice([None, *range(40)]), rnd.choice(["a\nb", "", None, "ñ\n", "x"]), rnd.choice([None, "en"]), rnd.choice([None, "s", "s", "s", "s", "é", "z", ""]), rnd.choice([None, 1]), "own") for _ in range(120)]
    rows += [(7, "alone", None, "one row", 5, "own")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block string")
    assert got(merkle.manifest(df)) == brute([dict(zip(COLUMNS, r)) for r in rows])


def test_small_tables(spark):
    df = spark.createDataFrame([(1, "x" * 300_000 + "\n", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert merkle.manifest(df.limit(0)).collect() == []
    found = got(merkle.manifest(df))
    assert found == brute([dict(zip(COLUMNS, r)) for r in df.select(*COLUMNS).collect()])
    assert found[0][1] == found[0][2] == found[0][3] and found[0][4] == h()


def test_combiners_take_children_in_any_order():
    for n in (1, 2, 3, 4, 9, 10, 28, 81, 100):
        leaves = [h(str(k)) for k in range(n)]
        order = random.Random(n).sample(range(n), n)
        partial = merkle.Partial(n, 99, links := {})
        for k in order:
            partial.offer(0, k, leaves[k])
        root, paths = tree(leaves)
        assert partial.frontier() == [(merkle.height(n), 0, root)] and not partial.open
        assert [[links[level, k // 3**level] for level in range(merkle.height(n))] for k in range(n)] == paths
