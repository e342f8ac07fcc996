"""The one place that says what may be retrieved: rejected records, placeholders, short page text, citations, access."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions.text import is_placeholder_status

MIN_PAGE_TEXT = 40


def not_rejected(review):
    """Records without an item have no review status and stay."""
    return review.isNull() | (review != "rejected")


def page_statuses(chunks: DataFrame) -> DataFrame:
    """(document_id, page, page_status): the status of a page is that of its own text, its first chunk's if it has several."""
    pages = chunks.filter("knowledge_item_id is null and asset_id is null and page_from is not null")
    return pages.groupBy("document_id", F.col("page_from").alias("page")).agg(F.min(F.struct("ordinal", "id", "content_status")).alias("m")).select(
        "document_id", "page", F.col("m.content_status").alias("page_status"))


def retrievable_chunks(chunks: DataFrame, documents: DataFrame, items: DataFrame) -> DataFrame:
    """Chunks that may be found, with the status they inherit and what kind of result they are.

    A chunk of a rejected item is hidden; page text under MIN_PAGE_TEXT characters too. placeholder_status is the first
    placeholder among the chunk's, the item's and the page's status.
    """
    page = page_statuses(chunks).select(F.col("document_id").alias("page_document"), "page", "page_status")
    c = chunks.select("id", "document_id", "knowledge_item_id", "asset_id", "page_from", "page_to", "ordinal", "text", "content_status")
    joined = (
        c.join(documents.select(F.col("id").alias("document_id"), F.col("slug").alias("document_slug"), "is_current"), "document_id")
        .join(items.select(F.col("id").alias("knowledge_item_id"), "item_type", "title", "review_status", F.col("content_status").alias("item_status")), "knowledge_item_id", "left")
        .join(page, (F.col("document_id") == F.col("page_document")) & (F.col("page_from") == F.col("page")), "left").drop("page_document", "page")
        .filter(not_rejected(F.col("review_status")))
        .filter(F.col("knowledge_item_id").isNotNull() | F.col("asset_id").isNotNull() | (F.length("text") >= MIN_PAGE_TEXT))
    )
    hold = [F.when(is_placeholder_status(F.col(x)), F.col(x)) for x in ("content_status", "item_status", "page_status")]
    return joined.withColumns({
        "result_kind": F.when(F.col("knowledge_item_id").isNotNull(), "item").when(F.col("asset_id").isNotNull(), "figure").otherwise("page"),
        "placeholder_status": F.coalesce(*hold),
        "has_citation": F.col("page_from").isNotNull() | F.col("page_to").isNotNull(),
    }).withColumn("is_placeholder", F.col("placeholder_status").isNotNull())


def first_citation(citations: DataFrame) -> DataFrame:
    """One citation per item: least page, those without page last, ties by id."""
    w = Window.partitionBy("knowledge_item_id").orderBy(F.col("page_index").asc_nulls_last(), "id")
    return citations.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def retrievable_items(items: DataFrame, documents: DataFrame, citations: DataFrame) -> DataFrame:
    cite = first_citation(citations).select("knowledge_item_id", "page_index", "printed_page_label")
    return (
        items.filter("review_status <> 'rejected'").withColumnRenamed("id", "knowledge_item_id")
        .join(documents.select(F.col("id").alias("document_id"), F.col("slug").alias("document_slug"), "doc_kind"), "document_id")
        .join(cite, "knowledge_item_id", "left").withColumn("is_placeholder", is_placeholder_status(F.col("content_status")))
    )


def guard(df: DataFrame, accounts: DataFrame, account_id: str | None, edit: bool = False) -> DataFrame:
    """The rows if the account is active (and, to edit, an owner or editor), else none; no account sees nothing."""
    ok = accounts.filter((F.col("account_id") == F.lit(account_id)) & (F.col("status") == "active"))
    if edit:
        ok = ok.filter(F.col("role").isin("owner", "editor"))
    return df.join(F.broadcast(ok.select(F.lit(1).alias("one")).limit(1)), how="left_semi", on=F.lit(True))  # one row at most
