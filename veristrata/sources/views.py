"""Domain views over the driver's tables: the same rows in Spark and, as text, in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").selectExpr(
        "concat(source, '/', lang, '/', doc_id, '.md') AS path", "sha2(text, 256) AS hash", "lang AS language", "cast(octet_length(text) AS bigint) AS size_bytes", "1704067200 + doc_id * 60 AS indexed_at"
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "concat('src', p_partkey % 20, '/m', p_partkey % 50, '.md') AS file_path", "p_name AS name", "concat(p_brand, '.', p_name) AS qualified_name", "p_type AS kind", "p_size AS start_line", "p_size + 3 AS end_line", "p_retailprice > 1000 AS exported"
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "o_orderpriority AS topic", "o_orderstatus AS choice", "concat('because ', o_custkey) AS reasoning", "unix_seconds(cast(o_orderdate AS timestamp)) AS recorded_at", "o_custkey AS author"
    )


def decision_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS id", "l_linenumber AS pos", "concat('p', l_partkey) AS ref")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims_of(_read(spark, sf_dir, "events"))


def claims_of(events: DataFrame) -> DataFrame:
    """Events, a table or a stream, as claims."""
    k = "cast(get_json_object(props, '$.k') AS bigint)"
    return events.selectExpr(
        "event_id AS id", "cast(user_id AS string) AS session_id", "event_type AS claim", "props AS evidence", "event_type NOT IN ('error', 'view') AS verified", "unix_seconds(cast(ts AS timestamp)) AS recorded_at",
        f"concat('src/f', {k}, '.py') AS file_path", "CASE event_type WHEN 'purchase' THEN true WHEN 'error' THEN false END AS vet_ok", f"CASE WHEN {k} % 3 = 0 THEN {k} * 3600 END AS ttl", "CASE WHEN event_type <> 'signup' THEN event_type END AS tool", "cast(NULL AS bigint) AS last_checked",
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "benchmark").selectExpr("cast(item_id + 1 AS int) AS ord", "concat('c', item_id % 4) AS category", "text")


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "concat('I shipped ', replace(p_brand, '#', ''), ' to ', p_size, ',000 users since 20', lpad(cast(p_size % 30 AS string), 2, '0'), ' and I prefer ', p_type) AS text"
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves (path, vtype, svalue, nvalue): constants, nations by region, and sizes of some parts."""
    fixed = spark.sql(FIXED_FACTS)
    nation = _read(spark, sf_dir, "nation").selectExpr("concat('regions.r', n_regionkey, '.nations[', n_nationkey, ']') AS path", "'string' AS vtype", "lower(n_name) AS svalue", "cast(NULL AS double) AS nvalue")
    sizes = _read(spark, sf_dir, "part").where("p_partkey % 97 = 0").selectExpr("concat('parts.users_', p_partkey) AS path", "'number' AS vtype", "cast(p_size * 1000 AS string) AS svalue", "cast(p_size * 1000 AS double) AS nvalue")
    return fixed.unionByName(nation).unionByName(sizes)


FIXED_FACTS = """SELECT * FROM VALUES
  ('product.name', 'string', 'atlas', cast(NULL AS double)), ('product.users', 'number', '12000', 12000.0D), ('product.brand', 'string', 'brand11', NULL),
  ('tech.primary', 'string', 'go', NULL), ('tech.secondary.note', 'string', 'hidden', NULL), ('tech.secondary.sensitivity', 'string', 'private', NULL),
  ('releases[0].shipped', 'date', '2024-03-05', NULL), ('releases[0].last_verified', 'date', '2024-01-01', NULL), ('releases[1].last_verified', 'date', '2025-12-01', NULL),
  ('releases[1].version', 'number', '1', 1.0D), ('limits.requests', 'number', '95', 95.0D), ('product.active', 'bool', 'true', NULL)
  AS t(path, vtype, svalue, nvalue)"""

#: DuckDB text of each view, for WITH clauses.
DUCK = {
    "v_files": "SELECT source||'/'||lang||'/'||doc_id||'.md' AS path, sha256(text) AS hash, lang AS language, CAST(strlen(text) AS BIGINT) AS size_bytes, 1704067200 + doc_id * 60 AS indexed_at FROM documents",
    "v_symbols": "SELECT p_partkey AS id, 'src'||(p_partkey % 20)||'/m'||(p_partkey % 50)||'.md' AS file_path, p_name AS name, p_brand||'.'||p_name AS qualified_name, p_type AS kind, p_size AS start_line, p_size + 3 AS end_line, p_retailprice > 1000 AS exported FROM part",
    "v_decisions": "SELECT o_orderkey AS id, o_orderpriority AS topic, o_orderstatus AS choice, 'because '||o_custkey AS reasoning, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS recorded_at, o_custkey AS author FROM orders",
    "v_refs": "SELECT l_orderkey AS id, l_linenumber AS pos, 'p'||l_partkey AS ref FROM lineitem",
    "v_claims": "SELECT event_id AS id, CAST(user_id AS VARCHAR) AS session_id, event_type AS claim, props AS evidence, event_type NOT IN ('error','view') AS verified, CAST(floor(epoch(ts)) AS BIGINT) AS recorded_at, 'src/f'||json_extract_string(props,'$.k')||'.py' AS file_path, CASE event_type WHEN 'purchase' THEN true WHEN 'error' THEN false END AS vet_ok, CASE WHEN CAST(json_extract_string(props,'$.k') AS BIGINT) % 3 = 0 THEN CAST(json_extract_string(props,'$.k') AS BIGINT) * 3600 END AS ttl, CASE WHEN event_type <> 'signup' THEN event_type END AS tool, CAST(NULL AS BIGINT) AS last_checked FROM events",
    "v_rules": "SELECT CAST(item_id + 1 AS INTEGER) AS ord, 'c'||(item_id % 4) AS category, text FROM benchmark",
    "v_prose": "SELECT p_partkey AS id, 'I shipped '||replace(p_brand,'#','')||' to '||p_size||',000 users since 20'||lpad(CAST(p_size % 30 AS VARCHAR),2,'0')||' and I prefer '||p_type AS text FROM part",
    "v_facts": "SELECT * FROM (VALUES ('product.name','string','atlas',CAST(NULL AS DOUBLE)),('product.users','number','12000',12000.0),('product.brand','string','brand11',NULL),('tech.primary','string','go',NULL),('tech.secondary.note','string','hidden',NULL),('tech.secondary.sensitivity','string','private',NULL),('releases[0].shipped','date','2024-03-05',NULL),('releases[0].last_verified','date','2024-01-01',NULL),('releases[1].last_verified','date','2025-12-01',NULL),('releases[1].version','number','1',1.0),('limits.requests','number','95',95.0),('product.active','bool','true',NULL)) t(path, vtype, svalue, nvalue) UNION ALL SELECT 'regions.r'||n_regionkey||'.nations['||n_nationkey||']', 'string', lower(n_name), NULL FROM nation UNION ALL SELECT 'parts.users_'||p_partkey, 'number', CAST(p_size * 1000 AS VARCHAR), CAST(p_size * 1000 AS DOUBLE) FROM part WHERE p_partkey % 97 = 0",
}
