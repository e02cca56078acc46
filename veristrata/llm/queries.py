"""The queries opN_<name>: each operator over its whole table with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, langid, media, merkle, mixing, neardup, neighbours, pii, quality_model, quality_rules, repair, urlfilter
from .common import table

#: Target shares; "*" stands for all other sources together. src0 is the hot one.
MIX_WEIGHTS = {"src0": 0.10, "src1": 0.08, "src2": 0.08, "src3": 0.08, "src4": 0.06, "src5": 0.06, "*": 0.54}
MIX_SEED = 17
#: Most documents that the language model is trained on.
LANGID_SAMPLE = 1000
TOKENIZER = "byte_bpe_50k.tiktoken"
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the vocabulary file lies; it is read on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the bytes they decode to, as digests. Null and empty texts have no ids; rows repeat as in documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, bpe.vocabulary(tokenizer_path())))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every whole text, and the cascade's verdict. Null and empty texts fail the base; rows repeat as in documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_rules.filter_quality(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a payload that a page refers to, stored, read back and described. Null texts are empty; equal texts are stored once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pages = media.documents_as_pages(docs)
    pages = pages.withColumn("doc", F.struct("doc_id", "n_bytes"))
    items = media.media_items(media.interleave(pages, "doc", "html"), "doc")
    read_back = media.describe(media.store(docs))
    out = media.resolve(items, read_back)
    return out.select("doc.doc_id", "doc.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text runs and media of every page in document order, with references and captions. Null pages have no items; rows repeat as in pages."""
    return media.page_sequences(table(spark, sf_dir, "pages").select("page_id", "html"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url, with redirects and canonical links that its HTML names. Null urls have empty host and path, and pass."""
    pages = table(spark, sf_dir, "pages")
    return urlfilter.judge(pages.select("page_id", "url"), URL_RULES, urlfilter.html_links(pages.select("url", "html")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target share asks for. A null source counts among the others; a null id hashes as empty."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, MIX_WEIGHTS, seed=MIX_SEED).select("doc_id", "copy", "source", "lang", "text")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, rendered and read back. Null texts are empty; rows that repeat are turns of their own."""
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], talks.schema)
    return chat.digests(chat.reconstruct(chat.log_of(talks.unionByName(more))))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every whole text. Null and empty texts have none; rows repeat as in documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.report(pii.detect(docs, pii.train(docs)))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document. Null and empty texts are alone; rows that repeat an id are one document."""
    return neardup.components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every whole text, learned from labels that are not held out. Null and empty texts are scored too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_model.classify(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from rows that are not held out. `und` for null texts and texts without a letter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs, langid.fit(docs, LANGID_SAMPLE))
    return found.select("doc_id", F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after its damage: faults, and the cheapest repair. Nulls count as one space; rows that repeat are rows of their own."""
    return repair.repaired(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and the root that its leaf folds to after tampering. Null values are leaves too; rows repeat as in documents."""
    return merkle.manifest(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found of each vector whose id is divisible by 100. Null, zero and non-finite vectors take no part; repeated rows count once."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_quality_rules": op2_quality_rules,
    "op3_media": op3_media,
    "page_sequences": page_sequences,
    "op4_pii": op4_pii,
    "op5_url_filters": op5_url_filters,
    "op6_mixing": op6_mixing,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_chat": op9_chat,
    "op10_language_id": op10_language_id,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}
