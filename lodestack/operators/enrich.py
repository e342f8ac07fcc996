"""Enrichment: tags from words, links from codes, references to documents, texts composed of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import clean, code_prefixes, word_tokens
from lodestack.sources.tables import stored

#: ranges in which titles are numbered, and the bits of such a number (that of the range and 33 of the row in it)
_RANGES, _NO_BITS = 64, 39


def keyword_tags(items: DataFrame, item_id: str, text: str, lexicon: list[tuple[str, str, float]]) -> DataFrame:
    """(item_id, term_id, confidence) for every phrase of the lexicon (phrase, term, confidence) that a text holds as whole words.

    The lexicon is part of the plan: one pass over the texts, no join. Of several phrases of a term the surest counts.
    """
    def hit(phrase: str):
        return F.col(text).rlike(rf"(?i)(?<![\w])\Q{phrase}\E(?![\w])")

    found = F.array_compact(F.array(*[F.when(hit(p), F.struct(F.lit(t).alias("term_id"), F.lit(c).alias("confidence"))) for p, t, c in lexicon]))
    return items.select(F.col(item_id).alias("item_id"), F.explode(found).alias("f")).groupBy("item_id", "f.term_id").agg(F.max("f.confidence").alias("confidence"))


def prefer_surest(tags: DataFrame) -> DataFrame:
    """Of tags from several rules the surest per item and term; an earlier rule (less `rule_no`) wins a tie."""
    best = F.max_by(F.struct("rule", "confidence"), F.struct("confidence", -F.col("rule_no"))).alias("b")
    return tags.groupBy("item_id", "term_id").agg(best).select("item_id", "term_id", "b.rule", "b.confidence")


def code_links(items: DataFrame, item_id: str, text: str, codes: DataFrame, pattern: str, within: str | None = None, confidence: float = 0.9) -> DataFrame:
    """Items to the codes their text names: codes are pulled out of the text, then equi-joined, if asked within a common column."""
    scope = [within] if within else []
    named = items.select(F.col(item_id).alias("item_id"), *scope, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))).alias("code"))
    return named.join(codes, ["code", *scope]).select("item_id", "code", "target_id", F.lit(confidence).alias("confidence"))


def resolve_references(refs: DataFrame, documents: DataFrame, least: float = 0.6, least_words: int = 2) -> DataFrame:
    """(ref_id, document_id, overlap): the document whose title shares the largest part of a reference's words, at least `least`.

    A reference meets only documents that share one of its rarest words: of n words, need of which must be shared, one of
    the n - need + 1 rarest is among them; they are scored where they meet, so no pair is shuffled or sorted: titles are
    numbered in the order of their ids, and the best of a reference is the least of numbers, kept by hash. References and titles of the same words go as one. Ties go to the smaller document
    id; references of fewer than `least_words` words resolve to nothing; words are counted once.
    """
    words_of = lambda c: F.array_join(F.array_sort(F.array_distinct(word_tokens(F.col(c)))), " ")  # noqa: E731 - a text is shuffled for less than an array
    r = refs.select("ref_id", words_of("raw_text").alias("said"))
    d = documents.select("document_id", words_of("title").alias("dw")).filter("dw <> ''").groupBy("dw").agg(F.min("document_id").alias("document_id"))
    d = stored(d.repartitionByRange(_RANGES, "document_id").sortWithinPartitions("document_id").withColumn("no", F.monotonically_increasing_id()))
    words = d.select("no", F.split("dw", " ").alias("dw")).select("no", "dw", F.explode("dw").alias("word"))
    known = words.groupBy("word").agg(F.count("*").alias("n_titles"))
    asked = r.select("said").distinct().withColumn("w", F.split("said", " ")).filter((F.col("said") != "") & (F.size("w") >= least_words))
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("n_titles", F.lit(0)).alias("n"), "word"))).alias("o")
    ranked = asked.select("said", F.explode("w").alias("word")).join(known, "word", "left").groupBy("said").agg(order)
    need = F.ceil(F.size("w") * F.lit(least - 5e-7)).cast("int")
    rare = ranked.select("said", F.col("o.word").alias("w")).select("said", "w", F.posexplode(F.slice("w", F.lit(1), F.size("w") - need + 1)).alias("at", "word"))
    met = rare.join(words, "word").filter(F.size("dw") >= need)
    met = met.filter(~F.arrays_overlap(F.slice("w", F.lit(1), F.col("at")), "dw"))  # a title with a rarer word of the reference met it there
    scored = met.select("said", "no", F.round(F.size(F.array_intersect("w", "dw")) / F.size("w"), 6).alias("overlap")).filter(F.col("overlap") >= least)
    best = F.min(F.round((1 - F.col("overlap")) * 1_000_000).cast("long") * F.lit(1 << _NO_BITS) + F.col("no")).alias("b")  # the largest overlap, then the least id
    found = r.join(scored.groupBy("said").agg(best), "said").groupBy("ref_id").agg(F.min("b").alias("b")).withColumn("no", F.col("b").bitwiseAND((1 << _NO_BITS) - 1))
    return found.join(d.select("no", "document_id"), "no").select("ref_id", "document_id", ((1_000_000 - F.shiftright("b", _NO_BITS)) / 1_000_000).alias("overlap"))


def reference_states(refs: DataFrame, documents: DataFrame) -> DataFrame:
    """(ref_id, resolution, document_id) of references with ref_id, ref_kind, raw_text.

    `resolved` where a title of the corpus matches; else `missing_source` for references to documents outside, and for those
    that name a module by its number and are of a chapter or page; `unresolved` for the rest.
    """
    found = resolve_references(refs, documents).select("ref_id", "document_id")
    numbered = F.col("ref_kind").isin("module_chapter", "page") & F.col("raw_text").rlike(r"(?i)\bmodule\s+[0-9]")
    outside = F.col("ref_kind").isin("external_document", "sibling_doc")
    state = F.when(F.col("document_id").isNotNull(), "resolved").when(F.coalesce(numbered | outside, F.lit(False)), "missing_source").otherwise("unresolved")
    return refs.select("ref_id", "ref_kind", "raw_text").join(found, "ref_id", "left").select("ref_id", state.alias("resolution"), "document_id")


def prefix_tags(items: DataFrame, item_id: str, code: str, terms: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(item_id, term_id, confidence): the term whose code is the longest prefix of an item's code, cut level by level.

    `terms` has code and term_id. Prefixes are exploded and equi-joined; ties go to the smaller term id.
    """
    cut_ = items.select(F.col(item_id).alias("item_id"), F.posexplode(code_prefixes(F.col(code))).alias("cut_off", "code"))
    best = F.min(F.struct("cut_off", "term_id")).alias("b")
    return cut_.join(terms.select("code", "term_id"), "code").groupBy("item_id").agg(best).select("item_id", "b.term_id", F.lit(confidence).alias("confidence"))


def same_branch(words: DataFrame, structural: DataFrame, paths: DataFrame) -> DataFrame:
    """Of keyword tags (item_id, term_id, ..) those of items without structural tags, and those whose path begins a structural
    tag's or goes on from it. `paths` has term_id and path; a term without path is in no branch."""
    mine = structural.join(paths, "term_id", "left").groupBy("item_id").agg(F.collect_set("path").alias("branches"))  # the tags of one item
    told = words.join(paths, "term_id", "left").join(mine, "item_id", "left")
    near = F.exists("branches", lambda p: F.startswith(p, F.col("path")) | F.startswith(F.col("path"), p))
    return told.filter(F.col("branches").isNull() | near).select(words.columns)


def link_stages(candidates: DataFrame, crosswalk: DataFrame, stages: DataFrame) -> DataFrame:
    """(item_id, stage_id, confidence): stages named by an item and those one step along the crosswalk, the surest of each.

    `candidates` has item_id, stage_id, confidence (of any rules, united); `crosswalk` has stage_id and equal_id; stages that
    `stages` (stage_id) doesn't know are dropped.
    """
    across = candidates.join(crosswalk, "stage_id").select("item_id", F.col("equal_id").alias("stage_id"), "confidence")
    return candidates.select("item_id", "stage_id", "confidence").unionByName(across).join(stages.select("stage_id").distinct(), "stage_id", "left_semi").groupBy(
        "item_id", "stage_id").agg(F.max("confidence").alias("confidence"))


def compose(base: Column, facts: list[tuple[str, Column]], fallback: Column) -> Column:
    """Base text and labelled facts, one per line; a fact that is null or stands in the base already is left out."""
    body = F.coalesce(clean(base), F.lit(""))
    lines = [F.when(v.isNotNull() & ~F.contains(F.lower(body), F.lower(clean(v.cast("string")))), F.concat(F.lit(f"{name}: "), clean(v.cast("string")))) for name, v in facts]
    text = F.concat_ws("\n", F.nullif(body, F.lit("")), *lines)
    return F.coalesce(F.nullif(text, F.lit("")), F.concat(F.lit("["), fallback, F.lit("]")))
