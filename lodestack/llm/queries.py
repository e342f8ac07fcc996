"""Queries of the text and vector problems (p2, p4, p6, p7, p8, p9)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import mixing, splitting
from lodestack.sources.tables import table

#: folder of the public tokenizer files; the same path must hold on every worker
TOKENIZERS = os.environ.get("LODESTACK_TOKENIZERS", "/opt/tokenizers")
#: how byte-level vocabularies of this family cut a text into words before merging (published with them)
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf_dir, "chunk")).withColumnRenamed("item_id", "chunk_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_pieces(spark, sf_dir).filter("piece_no = 0").select("chunk_id").distinct()


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per oversized chunk: pieces within the limit, new texts that give the text again, shared stretches of about 200 characters, pages in order."""
    chunks = table(spark, sf_dir, "chunk").select(F.col("id").alias("chunk_id"), "text", F.col("page_from").alias("first"), F.col("page_to").alias("last"))
    part = F.struct("piece_no", F.expr("substring(piece_text, new_from - char_from + 1)").alias("new"), "token_count", (F.col("new_from") - F.col("char_from")).alias("shared"), "page_from", "page_to")
    parts = p6_pieces(spark, sf_dir).groupBy("chunk_id").agg(F.array_sort(F.collect_list(part)).alias("p"))  # the pieces of one text
    inside = "(first is null and x.page_from is null) or (x.page_from >= first and x.page_to >= x.page_from and (last is null or last < first or x.page_to <= last))"
    return parts.join(chunks, "chunk_id").select(
        "chunk_id", F.expr(f"size(p) > 1 and forall(p, x -> x.token_count between 1 and {splitting.LIMIT_TOKENS})").alias("within_limit"),
        F.expr("array_join(transform(p, x -> x.new), '') = text").alias("gives_the_text"),
        F.expr(f"forall(slice(p, 2, size(p)), x -> x.shared between 0 and {splitting.OVERLAP_CHARS * 5 // 4})").alias("shares_a_stretch"),
        F.expr(f"forall(p, x -> {inside})").alias("pages_in_order"))


def _mix(spark: SparkSession, sf_dir: str):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", mixing.source_key(F.col("source")).alias("source"), "lang", "text")
    targets = table(spark, sf_dir, "mix_target")
    wanted = docs.join(F.broadcast(targets.select("source")), "source", "left_semi")  # 13 rows, fixed
    counted = mixing.count_tokens_and_topics(wanted, "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken", WORD_PATTERN, ["doc_id", "source", "lang"])
    return mixing.mix_sources(counted, targets)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents with their repeats."""
    return _mix(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def p8_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target source: whether its share is within a hundredth of its target among the sources that have documents, and its repeats within the cap."""
    shares = p8_shares(spark, sf_dir)
    whole = shares.filter("tokens > 0").agg(F.sum("target_share").alias("whole"))
    near = F.abs(F.col("share") - F.when(F.col("tokens") > 0, F.col("target_share") / F.col("whole")).otherwise(0.0)) <= 0.01
    return shares.crossJoin(F.broadcast(whole)).select("source", near.alias("on_target"), (F.col("most_repeats") <= F.col("max_repeats")).alias("within_cap"))  # one row


QUERIES = {"p6_found": p6_found, "p6_pieces": p6_pieces, "p6_roundtrip": p6_roundtrip, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_reached": p8_reached}
ORACLES: dict[str, str] = {
    # a word of n characters has ceil(n / 3) matches of up to three; the rest are single visible characters
    "p6_found": r"SELECT DISTINCT id AS chunk_id FROM chunk WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]{1,3}|[^\p{L}\p{N}_\s\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1680}]')) > 420",
}
ORACLES["p6_roundtrip"] = ORACLES["p6_found"].replace("chunk_id FROM", "chunk_id, true AS within_limit, true AS gives_the_text, true AS shares_a_stretch, true AS pages_in_order FROM")


ORACLES["p8_reached"] = "SELECT source, true AS on_target, true AS within_cap FROM mix_target"


def p9_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.llm import encoding

    return encoding.repair_encoding(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_repaired(spark, sf_dir).select("doc_id").distinct()


QUERIES |= {"p9_found": p9_found, "p9_repaired": p9_repaired}


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaking document with the items it leaks, the longest verbatim match and where it stands."""
    from lodestack.llm import leakage

    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "eval_id").distinct()


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents left when the affected ones are removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return docs.join(p7_leaks(spark, sf_dir).select("doc_id").distinct(), "doc_id", "left_anti")


QUERIES |= {"p7_found": p7_found, "p7_leaks": p7_leaks, "p7_clean": p7_clean}


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunk").select(
        F.col("id").alias("record_id"), F.col("document_id").alias("host"), F.col("content_status").alias("status"), F.lit("chunk").alias("kind"), "text")
    items = table(spark, sf_dir, "knowledge_item").select(
        F.col("id").alias("record_id"), F.col("document_id").alias("host"), F.col("content_status").alias("status"),
        F.lit("knowledge_item").alias("kind"), F.col("statement").alias("text"))
    return chunks.unionByName(items)


def p2_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with residue, with the segment that shows it and its score."""
    from lodestack.llm import residue

    return residue.find_residue(_texts(spark, sf_dir))[0].withColumnRenamed("kind", "record_kind")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_residue(spark, sf_dir).select("record_kind", "record_id").distinct()


def p2_retrievable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records left in the retrievable set."""
    bad = p2_found(spark, sf_dir)
    return _texts(spark, sf_dir).filter("text is not null").select(F.col("kind").alias("record_kind"), "record_id").join(
        bad, ["record_kind", "record_id"], "left_anti")


QUERIES |= {"p2_found": p2_found, "p2_residue": p2_residue, "p2_retrievable": p2_retrievable}


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar chunks of every chunk, with the cosine."""
    from lodestack.llm import neighbours

    return neighbours.nearest(table(spark, sf_dir, "chunk").select("id", "embedding")).withColumnsRenamed({"id": "chunk_id", "neighbour": "neighbour_id"})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_neighbours(spark, sf_dir).select(
        F.least("chunk_id", "neighbour_id").alias("chunk_id_1"), F.greatest("chunk_id", "neighbour_id").alias("chunk_id_2")).distinct()


QUERIES |= {"p4_found": p4_found, "p4_neighbours": p4_neighbours}

# brute force over all pairs: what the hashing must come to
ORACLES["p4_found"] = """WITH v AS (SELECT id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM chunk
  WHERE len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS c FROM v a JOIN v b ON a.id <> b.id),
t AS (SELECT a, b FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS chunk_id_1, greatest(a, b) AS chunk_id_2 FROM t"""
