"""From pages to items, chunks and citations: extractors by kind of document, checks of what they give, vectors for what lacks them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions.text import clean, is_placeholder_status, page_status

MAX_STATEMENT, MIN_PAGE_TEXT = 4000, 40
ITEMS = ["document_id", "page", "item_type", "title", "statement", "confidence"]
_EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def extractor(*kinds: str):
    """Registers a function from pages (document_id, doc_kind, page, text, content_status) to items for kinds of document."""
    def add(fn):
        for k in kinds:
            _EXTRACTORS[k] = fn
        return fn

    return add


@extractor("unknown", "standard")
def generic(pages: DataFrame) -> DataFrame:
    """One guidance item per real page: its first line the title, its text the statement. Both the recorded status and the text must be real."""
    body = clean(F.col("text"))
    real = pages.filter(~is_placeholder_status(F.col("content_status")) & (page_status(F.col("text")) == "real") & (F.length(body) >= MIN_PAGE_TEXT))
    title = F.substring(F.trim(F.element_at(F.split(F.ltrim(F.col("text")), "\n"), 1)), 1, 120)
    return real.select("document_id", "page", F.lit("guidance").alias("item_type"), title.alias("title"), F.substring(body, 1, MAX_STATEMENT).alias("statement"), F.lit(0.3).alias("confidence"))


def extract(pages: DataFrame, fallback: Callable[[DataFrame], DataFrame] = generic) -> DataFrame:
    """Items of all pages, each kind of document by its extractor, other kinds by the fallback; one narrow branch per extractor."""
    by_fn: dict = {}
    for kind, fn in _EXTRACTORS.items():
        by_fn.setdefault(fn, []).append(kind)
    known = [k for kinds in by_fn.values() for k in kinds]
    rest = ~F.coalesce(F.col("doc_kind").isin(known), F.lit(False))
    parts = []
    for fn, kinds in by_fn.items():
        mine = F.coalesce(F.col("doc_kind").isin(kinds), F.lit(False))
        parts.append(fn(pages.filter(mine | rest if fn is fallback else mine)).select(*ITEMS))
    if fallback not in by_fn:
        parts.append(fallback(pages.filter(rest)).select(*ITEMS))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def item_chunks(items: DataFrame, citations: DataFrame) -> DataFrame:
    """A chunk per item: title and statement, else the summary, else its type; its pages from the first to the last cited."""
    span = citations.groupBy("knowledge_item_id").agg(F.min("page_index").alias("page_from"), F.max("page_index").alias("page_to"))
    both = F.concat_ws("\n\n", F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim("statement"), F.lit("")))
    text = F.when(F.col("statement").isNotNull(), both).otherwise(F.coalesce(F.nullif(F.trim("summary"), F.lit("")), F.nullif(both, F.lit("")), F.concat(F.lit("["), F.col("item_type"), F.lit("]"))))
    return items.withColumnRenamed("id", "knowledge_item_id").join(span, "knowledge_item_id", "left").select("knowledge_item_id", "document_id", "page_from", "page_to", text.alias("text"))


def uncovered_pages(pages: DataFrame, citations: DataFrame) -> DataFrame:
    """Pages that no citation names."""
    return pages.join(citations.select("document_id", F.col("page_index").alias("page")).distinct(), ["document_id", "page"], "left_anti")


def label_citations(citations: DataFrame, labels: DataFrame) -> DataFrame:
    """Missing printed labels filled in from the pages."""
    known = labels.select("document_id", F.col("page").alias("page_index"), F.col("label").alias("page_label"))
    return citations.join(known, ["document_id", "page_index"], "left").withColumn("printed_page_label", F.coalesce("printed_page_label", "page_label")).drop("page_label")


def unknown_fields(payload_keys: Iterable[str], target: DataFrame) -> list[str]:
    """Keys of a payload that its table has no column for."""
    return sorted(set(payload_keys) - set(target.columns))


def resolve_refs(rows: DataFrame, ref: str, ids: DataFrame, out: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the id a reference stands for, or null; the references that stand for nothing)."""
    known = ids.select(F.col("ref").alias(ref), F.col("id").alias(out)).dropDuplicates([ref])
    joined = rows.join(known, ref, "left")
    return joined, joined.filter(F.col(ref).isNotNull() & F.col(out).isNull()).select(ref).distinct()


def run_stats(items: DataFrame) -> DataFrame:
    return items.groupBy("document_id").agg(F.count("*").alias("n_items"), F.countDistinct("page").alias("n_pages"), F.round(F.avg("confidence"), 6).alias("confidence"))


def cell_roles(cells: DataFrame) -> DataFrame:
    """Role of each spreadsheet cell (sheet, ref, value, formula): a formula others use is calc, else output; numbers are inputs, the rest labels."""
    used = cells.filter("formula is not null").select("sheet", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("formula"), F.lit(r"\$?([A-Z]{1,3})\$?(\d+)"), F.lit(0)))).alias("r"))
    used = used.select("sheet", F.regexp_replace("r", r"\$", "").alias("ref")).distinct().withColumn("used", F.lit(True))
    return cells.join(used, ["sheet", "ref"], "left").withColumn("role", F.when(F.col("formula").isNotNull(), F.when(F.col("used"), "calc").otherwise("output")).when(
        F.col("value").try_cast("double").isNotNull(), "input").otherwise("label")).drop("used")


def embed_missing(chunks: DataFrame, encode: Callable[[list[str]], list[list[float]]], text: str = "text", vector: str = "embedding", batch: int = 64) -> DataFrame:
    """Chunks with vectors filled in where they are null, `batch` texts at a time; `encode` is shipped to the workers once."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in chunks.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a in range(0, len(pdf), batch):
                out += encode(pdf[text].iloc[a : a + batch].tolist())
            yield pdf.assign(**{vector: pd.Series(out, index=pdf.index, dtype=object)})

    missing = chunks.filter(F.col(vector).isNull() & F.col(text).isNotNull())
    return chunks.filter(F.col(vector).isNotNull() | F.col(text).isNull()).unionByName(missing.mapInPandas(run, kinds))


def refresh_text(chunks: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """Chunks with new texts where these differ; a rewritten text loses its vector."""
    j = chunks.join(fresh.select(key, F.col("text").alias("new_text")), key, "left")
    changed = F.col("new_text").isNotNull() & ~F.col("new_text").eqNullSafe(F.col("text"))
    return j.withColumns({"embedding": F.when(~changed, F.col("embedding")), "text": F.when(changed, F.col("new_text")).otherwise(F.col("text"))}).drop("new_text")


def page_number_gaps(pages: DataFrame) -> DataFrame:
    """(document_id, after, missing): runs of page numbers that a document lacks."""
    w = Window.partitionBy("document_id").orderBy("page")
    return pages.select("document_id", "page").distinct().withColumn("after", F.lag("page").over(w)).filter(F.col("page") - F.col("after") > 1).select(
        "document_id", "after", (F.col("page") - F.col("after") - 1).alias("missing"))
