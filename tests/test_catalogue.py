"""Every query with SQL of its own is held against DuckDB at the smallest scale."""

import duckdb
import pytest

from veristrata.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    found = duck.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert plain(map(tuple, df.select(*cols).collect())) == plain(tuple(r[i] for i in at) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_forbidden_fuzzy_reads_documents_and_rules(spark, tmp_path):
    spark.createDataFrame([(1, "ab. The quick brown fox jumps."), (2, "the quikc brown fox"), (3, "the quick browm fox"), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "the quick brown fox"), (1, "jumps")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.doc_id, r.ord, r.start, r.end) for r in QUERIES["forbidden_fuzzy"](spark, str(tmp_path)).collect())
    assert got == [(1, 1, 4, 23), (1, 2, 24, 29), (3, 1, 0, 19)]


def test_uncovered_session_sentences(spark, tmp_path):
    rows = [(1, 0, "I prefer Go. Nothing here! "), (1, 0, "I prefer Go. Nothing here! "), (2, 1, None), (2, 2, "since 2020\nñ 95% yes")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r.conv_id, r.turn, r.sentence) for r in QUERIES["uncovered_session_sentences"](spark, str(tmp_path)).collect())
    assert got[:2] == [(1, 0, "Nothing here")] * 2 and (2, 2, "since 2020") in got


def test_facts_impact_by_context(spark):
    """Hits at word boundaries; strong where the words around name the path; the first strong line, else the first."""
    from veristrata.operators import detect

    docs = spark.createDataFrame([(1, "atlas and atlasses\nñ the Product is called\n Atlas, 12000"), (2, "go on, Go"), (3, None), (4, "atlasses a\\Eb")], "doc_id long, text string")
    leaves = spark.createDataFrame([("product.name", "atlas"), ("tech.primary", "go"), ("limits.users", "12000"), ("x.quoted", "a\\Eb"), ("x.none", None)], "path string, svalue string")
    got = sorted(map(tuple, detect.facts_impact(docs, leaves).collect()))
    assert got == [("limits.users", 1, 1, 0, 3), ("product.name", 1, 2, 1, 3), ("tech.primary", 2, 2, 0, 1), ("x.quoted", 4, 1, 0, 1)]


def _held(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    got = plain(map(tuple, df.select("id", df.columns[1]).collect()))
    assert got == plain(con.execute(ORACLES[name]).fetchall())
    return got


def parts(spark, folder, rows):
    spark.createDataFrame([(k, name, "Brand#1", "T", 1, 1.0) for k, name in rows], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")


def test_symbol_parents_of_shared_ids(spark, tmp_path):
    """Ids beyond a million meet those of the inner symbols; an inner symbol is no parent."""
    parts(spark, tmp_path, [(7, "a"), (1000007, "b"), (1000011, "c"), (207, "a.run.x"), (8, None)])
    got = _held(spark, tmp_path, "symbol_parents")
    assert (1000007, 7) in got and len({i for i, _ in got}) == len(got)


def test_lateral_symbols_are_read_by_many_tasks(spark, tmp_path):
    spark.range(0, 2000, 1, 1).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["lateral_symbols"](spark, str(tmp_path)).selectExpr("id", "language", "spark_partition_id() AS p").distinct().collect()
    assert len({r.p for r in got}) > 4 and len({(r.id, r.language) for r in got}) == 200 * 39


def test_edit_distance_pairs_are_whole(spark, tmp_path):
    parts(spark, tmp_path, [(1, "kitten of the north"), (2, "a whole other name"), (3, "a whole other names"), (4, None), (5, ""), (6, "ñu and more")])
    got = _held(spark, tmp_path, "edit_distance_pairs")
    assert max(d for _, d in got if d is not None) > 6
