"""Queries of the subpackage against SQL, and against brute force where SQL has no words for them."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import duckdb
import pytest

from veristrata.llm import langid, media, pii
from veristrata.llm.oracle import SQL
from veristrata.llm.queries import QUERIES, tokenizer_path

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return {r[0]: r for r in duckdb.sql(f"SELECT doc_id, coalesce(text, ''), lang FROM '{DATA}/documents.parquet'").fetchall()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    found = con.execute(SQL[name])
    at = [[c[0] for c in found.description].index(c) for c in cols]
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=str)


def test_op1_equals_tiktoken(spark, docs):
    import public_tokenizers
    import tiktoken

    from veristrata.llm import bpe

    pieces = bpe.load_ranks(tokenizer_path())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in enumerate(pieces)}, special_tokens={})
    for r in QUERIES["op1_byte_bpe"](spark, DATA).collect():
        ids = enc.encode_ordinary(docs[r.doc_id][1])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id][1].encode()).hexdigest()


def test_op3_reads_back_what_it_stored(spark, docs):
    rows = QUERIES["op3_media"](spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = docs[r.doc_id][1].encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        wav = media.to_wav(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())


def plain_spans(text):
    out = []
    kinds = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    for k, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(d) <= 19 and pii._luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_op4_base_spans(spark, docs):
    seen = Counter()
    for r in QUERIES["op4_pii"](spark, DATA).collect():
        want = plain_spans(docs[r.doc_id][1])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) | {""}
        kinds = Counter(x.split(":")[0] for x in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in pii.KINDS)
        seen += kinds
    assert seen


def test_op4_added_spans(spark):
    """The spans beside the base ones, from counts over all candidates and one text at a time."""
    data = DATA.replace("0.001", "0.01")
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{data}/documents.parquet'").fetchall())
    weights = pii.fit(Counter(c[4] for t in texts.values() for c in pii.candidates(t)))
    added = 0
    for r in QUERIES["op4_pii"](spark, data).collect():
        text = texts[r.doc_id]
        want = {c[:3] for c in pii.candidates(text) if c[3] or float(pii.design(c[4]) @ weights) >= 0}
        assert r.spans == ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(want, key=lambda x: (x[1], pii.ORDER[x[0]], x[2])))
        added += len(want) - r.n_email - r.n_ip - r.n_card - r.n_phone
    assert added > 0


def test_op3_features(spark, docs):
    for r in QUERIES["op3_media"](spark, DATA).collect():
        raw = docs[r.doc_id][1].encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        c = [x - 128 for x in payload]
        bins = Counter(x >> 4 for x in payload)
        crossings = sum((a < 0) != (b < 0) for a, b in zip(c, c[1:]))
        assert r.feature == f"frames={len(c)};sum={sum(c)};energy={sum(x * x for x in c)};crossings={crossings};bins={','.join(str(bins[k]) for k in range(16))}"


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for k, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(k)
    both = Counter(p for v in where.values() for p in itertools.combinations(sorted(v), 2))
    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sets, {k: find(k) for k in sets}


def test_op7_equals_brute_force(spark, docs):
    sets, root = groups({k: r[1] for k, r in docs.items()})
    for r in QUERIES["op7_near_duplicates"](spark, DATA).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root[r.doc_id], root[r.doc_id] == r.doc_id)


def test_op8_held_out(spark):
    data = DATA.replace("0.001", "0.01")
    labels = dict(duckdb.sql(f"SELECT doc_id, max(quality) FROM '{data}/labels.parquet' GROUP BY 1").fetchall())
    rows = QUERIES["op8_quality_classifier"](spark, data).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    told = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert sum(told) / len(told) > 0.9


def test_op10_held_out(spark):
    data = DATA.replace("0.001", "0.01")
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{data}/documents.parquet'").fetchall())
    rows = QUERIES["op10_language_id"](spark, data).collect()
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    told = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert sum(told) / len(told) > 0.97


def test_pipeline_equals_brute_force(spark, docs):
    import tiktoken
    import public_tokenizers

    import corpus_pipeline
    from veristrata.llm import bpe, mixing
    from veristrata.llm.queries import LANGID_SAMPLE, MIX_SEED, MIX_WEIGHTS

    table = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(table, LANGID_SAMPLE)
    import pyarrow as pa

    pred, score = langid.judge(pa.array([r[1] for r in docs.values()]), model)
    kept = {k: r[1] for (k, r), p, s in zip(docs.items(), pred, score) if p != langid.UND and s >= corpus_pipeline.MIN_LANGUAGE_SCORE}
    assert len(kept) >= 0.97 * len(docs)
    _, root = groups(kept)
    kept = {k: t for k, t in kept.items() if root[k] == k}
    weights = pii.fit(Counter(c[4] for t in kept.values() for c in pii.candidates(t)))
    kept = {k: pii.mask(t, pii.find(t, weights)) for k, t in kept.items()}
    source = dict(duckdb.sql(f"SELECT doc_id, source FROM '{DATA}/documents.parquet'").fetchall())
    n = Counter(source[k] if source[k] in MIX_WEIGHTS else None for k in kept)
    whole = sum(w for k, w in MIX_WEIGHTS.items() if n.get(None if k == "*" else k))
    pieces = bpe.load_ranks(tokenizer_path())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in enumerate(pieces)}, special_tokens={})
    want = Counter()
    for k, t in kept.items():
        g = source[k] if source[k] in MIX_WEIGHTS else None
        rate = len(kept) * (MIX_WEIGHTS[g or "*"] / whole) / n[g]
        u = int(hashlib.md5(f"{MIX_SEED}:{k}".encode()).hexdigest()[:13], 16) / (1 << 52)
        copies = sum(p <= u for p in mixing.poisson_cdf(rate))
        if copies:
            want[(k, " ".join(map(str, enc.encode_ordinary(t))))] += copies
    got = Counter((r.doc_id, " ".join(map(str, r.ids))) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == want
