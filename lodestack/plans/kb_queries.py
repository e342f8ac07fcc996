"""Queries over the document knowledge base: policy, facets, reports, search, browsing, structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions import text as T
from lodestack.functions import values
from lodestack.operators import enrich, extraction, facets, policy, ranking, structure
from lodestack.sources.tables import table

QUERIES, ORACLES = {}, {}
TERM = "region.t000"
SECOND = "building_use.t000"
SEARCH = "courtyard embodied carbon -tender"
WIDE = "rooflight or clerestory"
_PLACE = "('lorem','template','wip','draft')"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _t(spark: SparkSession, sf: str):
    return lambda name: table(spark, sf, name)


# --- policy ---------------------------------------------------------------------------------------------------------
@query(f"""SELECT content_status, (content_status IS NOT NULL AND content_status IN {_PLACE}) AS is_placeholder, CAST(count(*) AS BIGINT) AS n
FROM chunk GROUP BY 1, 2""")
def placeholder_status(spark, sf):
    df = _t(spark, sf)("chunk")
    return df.groupBy("content_status", T.is_placeholder_status(F.col("content_status")).alias("is_placeholder")).agg(F.count("*").alias("n"))


_RETRIEVABLE = f"""
WITH page AS (SELECT document_id, page_from AS page, (array_agg(content_status ORDER BY ordinal, id, content_status NULLS FIRST))[1] AS page_status
  FROM chunk WHERE knowledge_item_id IS NULL AND asset_id IS NULL AND page_from IS NOT NULL GROUP BY 1, 2),
r AS (SELECT c.id, c.document_id, d.slug AS document_slug, c.knowledge_item_id, c.asset_id, c.page_from, c.page_to, c.text, k.item_type, k.title,
    CASE WHEN c.knowledge_item_id IS NOT NULL THEN 'item' WHEN c.asset_id IS NOT NULL THEN 'figure' ELSE 'page' END AS result_kind,
    coalesce(CASE WHEN c.content_status IN {_PLACE} THEN c.content_status END, CASE WHEN k.content_status IN {_PLACE} THEN k.content_status END,
             CASE WHEN p.page_status IN {_PLACE} THEN p.page_status END) AS placeholder_status,
    (c.page_from IS NOT NULL OR c.page_to IS NOT NULL) AS has_citation
  FROM chunk c JOIN source_document d ON d.id = c.document_id LEFT JOIN knowledge_item k ON k.id = c.knowledge_item_id
  LEFT JOIN page p ON p.document_id = c.document_id AND p.page = c.page_from
  WHERE (k.review_status IS NULL OR k.review_status <> 'rejected')
    AND (c.knowledge_item_id IS NOT NULL OR c.asset_id IS NOT NULL OR length(c.text) >= 40))
"""


def _retrievable(spark, sf) -> DataFrame:
    t = _t(spark, sf)
    return policy.retrievable_chunks(t("chunk"), t("source_document"), t("knowledge_item"))


@query(_RETRIEVABLE + "SELECT id, document_slug, result_kind, placeholder_status, placeholder_status IS NOT NULL AS is_placeholder, has_citation FROM r")
def retrievable_chunk(spark, sf):
    return _retrievable(spark, sf).select("id", "document_slug", "result_kind", "placeholder_status", "is_placeholder", "has_citation")


@query(_RETRIEVABLE + "SELECT result_kind, placeholder_status, CAST(count(*) AS BIGINT) AS n FROM r WHERE has_citation GROUP BY 1, 2")
def retrievable_kinds(spark, sf):
    return _retrievable(spark, sf).filter("has_citation").groupBy("result_kind", "placeholder_status").agg(F.count("*").alias("n"))


_ITEMS = f"""
WITH cite AS (SELECT * FROM (SELECT knowledge_item_id, page_index, printed_page_label,
    row_number() OVER (PARTITION BY knowledge_item_id ORDER BY page_index NULLS LAST, id) AS rn FROM citation) WHERE rn = 1),
ri AS (SELECT k.id AS knowledge_item_id, d.slug AS document_slug, d.doc_kind, k.item_type, k.title, k.content_status, k.review_status, k.extraction_confidence,
    c.page_index, c.printed_page_label, coalesce(k.content_status IN {_PLACE}, false) AS is_placeholder
  FROM knowledge_item k JOIN source_document d ON d.id = k.document_id LEFT JOIN cite c ON c.knowledge_item_id = k.id WHERE k.review_status <> 'rejected')
"""


def _items(spark, sf) -> DataFrame:
    t = _t(spark, sf)
    return policy.retrievable_items(t("knowledge_item"), t("source_document"), t("citation").dropDuplicates())


@query(_ITEMS + "SELECT knowledge_item_id, document_slug, page_index, is_placeholder FROM ri")
def retrievable_item(spark, sf):
    return _items(spark, sf).select("knowledge_item_id", "document_slug", "page_index", "is_placeholder")


@query("SELECT 'owner' AS who, CAST(count(*) AS BIGINT) AS n FROM knowledge_item UNION ALL SELECT 'revoked', 0 UNION ALL SELECT 'nobody', 0")
def account_guard(spark, sf):
    items = _t(spark, sf)("knowledge_item")
    accounts = spark.createDataFrame([("a", "active", "owner"), ("b", "revoked", "editor")], "account_id string, status string, role string")
    parts = [policy.guard(items, accounts, a).agg(F.count("*").alias("n")).select(F.lit(w).alias("who"), "n") for w, a in (("owner", "a"), ("revoked", "b"), ("nobody", None))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- facets ---------------------------------------------------------------------------------------------------------
_SUB = """
WITH sub AS (SELECT DISTINCT r.id AS root_id, t.id AS term_id FROM taxonomy_term r JOIN taxonomy_term t
    ON r.taxonomy_id = t.taxonomy_id AND (t.id = r.id OR (r.path IS NOT NULL AND t.path IS NOT NULL AND (t.path = r.path OR starts_with(t.path, r.path || '.'))))),
tag AS (SELECT knowledge_item_id AS item_id, building_use_id AS term_id FROM benchmark WHERE building_use_id IS NOT NULL
    UNION SELECT knowledge_item_id, region_id FROM benchmark WHERE region_id IS NOT NULL),
tagged AS (SELECT tag.item_id, sub.root_id FROM tag JOIN sub ON sub.term_id = tag.term_id)
"""


def _tags(spark, sf) -> DataFrame:
    b = _t(spark, sf)("benchmark")
    return b.select(F.col("knowledge_item_id").alias("item_id"), F.explode(F.array_compact(F.array("building_use_id", "region_id"))).alias("term_id")).distinct()


def _tagged(spark, sf) -> DataFrame:
    return facets.item_subtree(_tags(spark, sf), facets.term_subtrees(_t(spark, sf)("taxonomy_term")))


@query(_SUB + "SELECT root_id, CAST(count(*) AS BIGINT) AS n_terms FROM sub GROUP BY 1")
def term_subtree(spark, sf):
    return facets.term_subtrees(_t(spark, sf)("taxonomy_term")).groupBy("root_id").agg(F.count("*").alias("n_terms"))


@query(_SUB + """SELECT t.id AS term_id, t.code, t.label, CAST(count(DISTINCT k.id) AS BIGINT) AS n_items FROM taxonomy_term t
LEFT JOIN tagged g ON g.root_id = t.id LEFT JOIN knowledge_item k ON k.id = g.item_id AND k.review_status <> 'rejected' GROUP BY 1, 2, 3""")
def term_item_count(spark, sf):
    t = _t(spark, sf)
    return facets.term_counts(t("taxonomy_term"), _tagged(spark, sf), t("knowledge_item"))


@query(_SUB + f"SELECT k.id, k.title FROM knowledge_item k WHERE EXISTS (SELECT 1 FROM tagged g WHERE g.item_id = k.id AND g.root_id = '{TERM}')")
def facet_filter(spark, sf):
    return facets.filter_by_terms(_t(spark, sf)("knowledge_item").select("id", "title"), _tagged(spark, sf), [TERM], "id")


@query(_SUB + f"""SELECT k.id, k.title FROM knowledge_item k WHERE EXISTS (SELECT 1 FROM tagged g WHERE g.item_id = k.id AND g.root_id = '{TERM}')
AND EXISTS (SELECT 1 FROM tagged g WHERE g.item_id = k.id AND g.root_id = '{SECOND}')""")
def facet_conjunction(spark, sf):
    return facets.filter_by_terms(_t(spark, sf)("knowledge_item").select("id", "title"), _tagged(spark, sf), [TERM, SECOND], "id")


@query(_SUB + f"""SELECT coalesce(EXISTS (SELECT 1 FROM tagged g WHERE g.item_id = k.id AND g.root_id = '{TERM}'), false) AS ok, k.item_type, CAST(count(*) AS BIGINT) AS n
FROM knowledge_item k GROUP BY 1, 2""")
def facet_flag(spark, sf):
    return facets.flag_by_term(_t(spark, sf)("knowledge_item").select("id", "item_type"), _tagged(spark, sf), TERM, "id").groupBy("ok", "item_type").agg(F.count("*").alias("n"))


@query("""SELECT d.slug, count(k.id)::BIGINT AS n_items, count(k.id) FILTER (WHERE k.review_status = 'rejected')::BIGINT AS n_rejected
FROM source_document d LEFT JOIN knowledge_item k ON k.document_id = d.id WHERE d.is_current GROUP BY 1""")
def facet_documents(spark, sf):
    t = _t(spark, sf)
    d = t("source_document").filter("is_current").select(F.col("id").alias("document_id"), "slug")
    return d.join(t("knowledge_item").select("document_id", "id", "review_status"), "document_id", "left").groupBy("slug").agg(
        F.count("id").alias("n_items"), F.count(F.when(F.col("review_status") == "rejected", F.col("id"))).alias("n_rejected"))


@query("""SELECT (SELECT count(*) FROM source_document WHERE is_current)::BIGINT AS n_documents, (SELECT coalesce(sum(page_count), 0) FROM source_document)::BIGINT AS n_pages,
(SELECT count(*) FROM knowledge_item WHERE review_status <> 'rejected')::BIGINT AS n_items, (SELECT count(DISTINCT item_type) FROM knowledge_item)::BIGINT AS n_types""")
def home_totals(spark, sf):
    t = _t(spark, sf)
    d = t("source_document").agg(F.count(F.when(F.col("is_current"), 1)).alias("n_documents"), F.coalesce(F.sum("page_count"), F.lit(0)).cast("long").alias("n_pages"))
    k = t("knowledge_item").agg(F.count(F.when(F.col("review_status") != "rejected", 1)).alias("n_items"), F.countDistinct("item_type").alias("n_types"))
    return d.crossJoin(k)  # one row each


@query(_SUB + """SELECT t.taxonomy_id, t.code, CAST(count(DISTINCT k.id) AS BIGINT) AS n FROM taxonomy_term t JOIN tagged g ON g.root_id = t.id
JOIN knowledge_item k ON k.id = g.item_id AND k.review_status <> 'rejected' WHERE t.parent_id IS NULL GROUP BY t.taxonomy_id, t.id, t.code""")
def root_topics(spark, sf):
    t = _t(spark, sf)
    counts = facets.term_counts(t("taxonomy_term"), _tagged(spark, sf), t("knowledge_item")).filter("n_items > 0")
    roots = t("taxonomy_term").filter("parent_id is null").select(F.col("id").alias("term_id"), "taxonomy_id")
    return counts.join(roots, "term_id").select("taxonomy_id", "code", F.col("n_items").alias("n"))


# --- reporting views ------------------------------------------------------------------------------------------------
_BENCH = f"""FROM benchmark b JOIN knowledge_item k ON k.id = b.knowledge_item_id JOIN source_document d ON d.id = k.document_id JOIN metric m ON m.id = b.metric_id
LEFT JOIN unit u ON u.id = b.unit_id LEFT JOIN (SELECT DISTINCT * FROM citation) c ON c.knowledge_item_id = k.id WHERE k.review_status <> 'rejected'"""


def _benchmarks(spark, sf) -> DataFrame:
    t = _t(spark, sf)
    k = t("knowledge_item").filter("review_status <> 'rejected'").select(F.col("id").alias("knowledge_item_id"), "document_id", "title", "content_status")
    return (
        t("benchmark").join(k, "knowledge_item_id").join(t("source_document").select(F.col("id").alias("document_id"), F.col("slug").alias("document_slug")), "document_id")
        .join(t("metric").select(F.col("id").alias("metric_id"), F.col("name").alias("metric_name")), "metric_id")
        .join(t("unit").select(F.col("id").alias("unit_id"), "symbol"), "unit_id", "left")
        .join(t("citation").dropDuplicates().select("knowledge_item_id", "page_index", "printed_page_label"), "knowledge_item_id", "left")
        .withColumn("is_placeholder_content", T.is_placeholder_status(F.col("content_status"))))


@query(f"""SELECT b.knowledge_item_id, d.slug AS document_slug, m.name AS metric_name, b.value_text, u.symbol, c.page_index, b.is_placeholder,
coalesce(k.content_status IN {_PLACE}, false) AS is_placeholder_content {_BENCH}""")
def benchmark_view(spark, sf):
    return _benchmarks(spark, sf).select("knowledge_item_id", "document_slug", "metric_name", "value_text", "symbol", "page_index", "is_placeholder", "is_placeholder_content")


@query(f"""SELECT b.knowledge_item_id, b.value_text, c.page_index {_BENCH} AND m.id = 'eui' AND c.page_index IS NOT NULL AND NOT b.is_placeholder
AND NOT coalesce(k.content_status IN {_PLACE}, false)""")
def benchmark_lookup(spark, sf):
    return _benchmarks(spark, sf).filter("metric_id = 'eui' and page_index is not null and not is_placeholder and not is_placeholder_content").select(
        "knowledge_item_id", "value_text", "page_index")


@query(f"""SELECT m.name AS metric_name, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT b.knowledge_item_id) AS BIGINT) AS n_items,
round(min(b.value_numeric), 6) AS least, round(max(b.value_numeric), 6) AS most {_BENCH} GROUP BY 1""")
def benchmark_summary(spark, sf):
    return _benchmarks(spark, sf).groupBy("metric_name").agg(
        F.count("*").alias("n_rows"), F.countDistinct("knowledge_item_id").alias("n_items"), F.round(F.min("value_numeric"), 6).alias("least"), F.round(F.max("value_numeric"), 6).alias("most"))


_REQ = """FROM requirement r JOIN knowledge_item k ON k.id = r.knowledge_item_id JOIN source_document d ON d.id = k.document_id LEFT JOIN criterion cr ON cr.id = r.criterion_id
LEFT JOIN unit u ON u.id = r.unit_id LEFT JOIN (SELECT DISTINCT * FROM citation) c ON c.knowledge_item_id = k.id WHERE k.review_status <> 'rejected'"""


def _requirements(spark, sf) -> DataFrame:
    t = _t(spark, sf)
    k = t("knowledge_item").filter("review_status <> 'rejected'").select(F.col("id").alias("knowledge_item_id"), "document_id", "title")
    return (
        t("requirement").join(k, "knowledge_item_id").join(t("source_document").select(F.col("id").alias("document_id"), F.col("slug").alias("document_slug")), "document_id")
        .join(t("criterion").select(F.col("id").alias("criterion_id"), "framework_id", F.col("code").alias("criterion_code"), "title_primary"), "criterion_id", "left")
        .join(t("unit").select(F.col("id").alias("unit_id"), "symbol"), "unit_id", "left")
        .join(t("citation").dropDuplicates().select("knowledge_item_id", "page_index"), "knowledge_item_id", "left"))


@query(f"SELECT r.knowledge_item_id, d.slug AS document_slug, cr.framework_id, cr.code AS criterion_code, r.requirement_kind, r.target_text, u.symbol, c.page_index {_REQ}")
def requirement_matrix(spark, sf):
    return _requirements(spark, sf).select("knowledge_item_id", "document_slug", "framework_id", "criterion_code", "requirement_kind", "target_text", "symbol", "page_index")


@query(f"SELECT DISTINCT r.knowledge_item_id, cr.code AS criterion_code, r.target_text {_REQ} AND cr.framework_id = 'fw-000001' AND r.requirement_kind = 'graded' AND c.page_index IS NOT NULL")
def requirement_lookup(spark, sf):
    return _requirements(spark, sf).filter("framework_id = 'fw-000001' and requirement_kind = 'graded' and page_index is not null").select(
        "knowledge_item_id", "criterion_code", "target_text").distinct()


@query(f"""SELECT cr.framework_id, r.requirement_kind AS scope, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE r.target_text IS NOT NULL) AS BIGINT) AS n_applies,
bool_or(r.is_deliverable) AS any_deliverable {_REQ} GROUP BY 1, 2""")
def scope_matrix(spark, sf):
    return _requirements(spark, sf).groupBy("framework_id", F.col("requirement_kind").alias("scope")).agg(
        F.count("*").alias("n_rows"), F.count("target_text").alias("n_applies"), F.bool_or("is_deliverable").alias("any_deliverable"))


@query("SELECT DISTINCT r.requirement_kind AS sheet, cr.framework_id FROM requirement r JOIN criterion cr ON cr.id = r.criterion_id JOIN knowledge_item k ON k.id = r.knowledge_item_id WHERE k.review_status <> 'rejected'")
def matrix_sheets(spark, sf):
    t = _t(spark, sf)
    live = t("knowledge_item").filter("review_status <> 'rejected'").select(F.col("id").alias("knowledge_item_id"))
    return t("requirement").join(live, "knowledge_item_id", "left_semi").join(t("criterion").select(F.col("id").alias("criterion_id"), "framework_id"), "criterion_id").select(
        F.col("requirement_kind").alias("sheet"), "framework_id").distinct()


@query("""WITH kinds AS (SELECT DISTINCT requirement_kind FROM requirement), grid AS (SELECT c.id, c.framework_id, c.code, k.requirement_kind FROM criterion c CROSS JOIN kinds k),
cell AS (SELECT r.criterion_id, r.requirement_kind, count(*) AS n, string_agg(r.knowledge_item_id, ',' ORDER BY r.knowledge_item_id) AS items FROM requirement r
  JOIN knowledge_item k ON k.id = r.knowledge_item_id WHERE k.review_status <> 'rejected' GROUP BY 1, 2)
SELECT g.framework_id, g.code, g.requirement_kind, CAST(coalesce(c.n, 0) AS BIGINT) AS n, coalesce(c.items, '') AS items FROM grid g
LEFT JOIN cell c ON c.criterion_id = g.id AND c.requirement_kind = g.requirement_kind""")
def matrix_pivot(spark, sf):
    """Every criterion with every kind, empty cells too; items in order."""
    t = _t(spark, sf)
    req = t("requirement")
    live = t("knowledge_item").filter("review_status <> 'rejected'").select(F.col("id").alias("knowledge_item_id"))
    kinds = req.select("requirement_kind").distinct()
    grid = t("criterion").select(F.col("id").alias("criterion_id"), "framework_id", "code").crossJoin(F.broadcast(kinds))  # a handful of kinds
    cells = req.join(live, "knowledge_item_id", "left_semi").groupBy("criterion_id", "requirement_kind").agg(
        F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("knowledge_item_id")), ",").alias("items"))
    return grid.join(cells, ["criterion_id", "requirement_kind"], "left").select(
        "framework_id", "code", "requirement_kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("items", F.lit("")).alias("items"))


@query("""SELECT framework_id, CAST(count(*) AS BIGINT) AS n_criteria, CAST(count(*) FILTER (WHERE parent_id IS NULL) AS BIGINT) AS n_roots FROM criterion GROUP BY 1""")
def framework_list(spark, sf):
    return _t(spark, sf)("criterion").groupBy("framework_id").agg(F.count("*").alias("n_criteria"), F.count(F.when(F.col("parent_id").isNull(), 1)).alias("n_roots"))


@query("""SELECT k.document_id, d.slug, coalesce(k.content_status, 'none') AS status, CAST(count(*) AS BIGINT) AS n,
CAST(round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY k.document_id), 3) AS DOUBLE) AS share
FROM knowledge_item k JOIN source_document d ON d.id = k.document_id GROUP BY 1, 2, 3""")
def status_breakdown(spark, sf):
    t = _t(spark, sf)
    k = t("knowledge_item").groupBy("document_id", F.coalesce("content_status", F.lit("none")).alias("status")).agg(F.count("*").alias("n"))
    total = k.groupBy("document_id").agg(F.sum("n").alias("total"))
    return k.join(total, "document_id").join(t("source_document").select(F.col("id").alias("document_id"), "slug"), "document_id").select(
        "document_id", "slug", "status", "n", F.round(F.col("n") / F.col("total"), 3).alias("share"))


@query("""SELECT document_id, count(*)::BIGINT AS n, (count(*) FILTER (WHERE content_status IN ('lorem','template','wip','draft')) > 0.15 * count(*)) AS is_mixed
FROM chunk WHERE knowledge_item_id IS NULL AND asset_id IS NULL GROUP BY 1""")
def mixed_documents(spark, sf):
    pages = _t(spark, sf)("chunk").filter("knowledge_item_id is null and asset_id is null")
    bad = F.count(F.when(T.is_placeholder_status(F.col("content_status")), 1))
    return pages.groupBy("document_id").agg(F.count("*").alias("n"), (bad > 0.15 * F.count("*")).alias("is_mixed"))


@query("SELECT slug, count(*)::BIGINT AS n, count(DISTINCT sha256)::BIGINT AS n_contents, count(DISTINCT doc_kind)::BIGINT AS n_kinds FROM source_document GROUP BY 1 HAVING count(*) > 1")
def duplicate_slugs(spark, sf):
    return _t(spark, sf)("source_document").groupBy("slug").agg(F.count("*").alias("n"), F.countDistinct("sha256").alias("n_contents"), F.countDistinct("doc_kind").alias("n_kinds")).filter("n > 1")


# --- browsing -------------------------------------------------------------------------------------------------------
@query(_ITEMS + """SELECT knowledge_item_id, document_slug, item_type, title, (SELECT count(*) FROM ri)::BIGINT AS total FROM ri
ORDER BY document_slug, item_type, title NULLS LAST, knowledge_item_id LIMIT 25 OFFSET 25""")
def browse_page(spark, sf):
    """The second page of 25, with the total from a count of its own so that the page stays a bounded sort."""
    items = _items(spark, sf)
    page = items.orderBy("document_slug", "item_type", F.col("title").asc_nulls_last(), "knowledge_item_id").offset(25).limit(25)
    return page.crossJoin(F.broadcast(items.agg(F.count("*").alias("total")))).select("knowledge_item_id", "document_slug", "item_type", "title", "total")


@query("""WITH q AS (SELECT k.id, k.title, k.extraction_confidence, k.document_id FROM knowledge_item k WHERE k.review_status = 'pending'),
c AS (SELECT * FROM (SELECT knowledge_item_id, page_index, row_number() OVER (PARTITION BY knowledge_item_id ORDER BY page_index NULLS LAST, id) AS rn FROM citation) WHERE rn = 1)
SELECT q.id, q.title, q.extraction_confidence, c.page_index FROM q LEFT JOIN c ON c.knowledge_item_id = q.id ORDER BY q.extraction_confidence NULLS FIRST, q.id LIMIT 25""")
def review_queue_page(spark, sf):
    t = _t(spark, sf)
    page = t("knowledge_item").filter("review_status = 'pending'").orderBy(F.col("extraction_confidence").asc_nulls_first(), "id").limit(25)
    cite = policy.first_citation(t("citation").dropDuplicates()).select(F.col("knowledge_item_id").alias("id"), "page_index")
    return page.select("id", "title", "extraction_confidence").join(cite, "id", "left").select("id", "title", "extraction_confidence", "page_index")


@query("""SELECT k.id, k.item_type, k.title, d.slug, coalesce(string_agg(DISTINCT c.page_index::VARCHAR, ',' ORDER BY c.page_index::VARCHAR), '') AS pages,
count(DISTINCT c.id)::BIGINT AS n_citations, (SELECT min(b.value_text) FROM benchmark b WHERE b.knowledge_item_id = k.id) AS benchmark_text,
(SELECT min(r.target_text) FROM requirement r WHERE r.knowledge_item_id = k.id) AS requirement_text
FROM knowledge_item k JOIN source_document d ON d.id = k.document_id LEFT JOIN citation c ON c.knowledge_item_id = k.id GROUP BY 1, 2, 3, 4""")
def item_detail(spark, sf):
    """Each item with its citations and typed payload, each side aggregated before it is joined."""
    t = _t(spark, sf)
    cite = t("citation").groupBy(F.col("knowledge_item_id").alias("id")).agg(
        F.array_join(F.sort_array(F.collect_set(F.col("page_index").cast("string"))), ",").alias("pages"), F.countDistinct("id").alias("n_citations"))
    bench = t("benchmark").groupBy(F.col("knowledge_item_id").alias("id")).agg(F.min("value_text").alias("benchmark_text"))
    req = t("requirement").groupBy(F.col("knowledge_item_id").alias("id")).agg(F.min("target_text").alias("requirement_text"))
    return (t("knowledge_item").select("id", "item_type", "title", "document_id").join(t("source_document").select(F.col("id").alias("document_id"), "slug"), "document_id")
            .join(cite, "id", "left").join(bench, "id", "left").join(req, "id", "left")
            .select("id", "item_type", "title", "slug", F.coalesce("pages", F.lit("")).alias("pages"), F.coalesce("n_citations", F.lit(0)).cast("long").alias("n_citations"), "benchmark_text", "requirement_text"))


@query("""SELECT document_id, page_from AS page, count(*) FILTER (WHERE asset_id IS NOT NULL)::BIGINT AS n_figures, count(*) FILTER (WHERE knowledge_item_id IS NOT NULL)::BIGINT AS n_items,
coalesce(string_agg(asset_id, ',' ORDER BY ordinal, asset_id) FILTER (WHERE asset_id IS NOT NULL), '') AS figures FROM chunk WHERE page_from IS NOT NULL GROUP BY 1, 2""")
def page_detail(spark, sf):
    c = _t(spark, sf)("chunk").filter("page_from is not null")
    figures = F.array_sort(F.collect_list(F.when(F.col("asset_id").isNotNull(), F.struct("ordinal", "asset_id"))))
    return c.groupBy("document_id", F.col("page_from").alias("page")).agg(
        F.count("asset_id").alias("n_figures"), F.count("knowledge_item_id").alias("n_items"), F.array_join(F.transform(figures, lambda x: x["asset_id"]), ",").alias("figures"))


@query("""SELECT c.knowledge_item_id, d.slug, c.page_index, c.printed_page_label, coalesce(c.printed_page_label, c.page_index::VARCHAR, '?') AS label
FROM (SELECT DISTINCT * FROM citation) c JOIN source_document d ON d.id = c.document_id""")
def citation_lookup(spark, sf):
    t = _t(spark, sf)
    return t("citation").dropDuplicates().join(t("source_document").select(F.col("id").alias("document_id"), "slug"), "document_id").select(
        "knowledge_item_id", "slug", "page_index", "printed_page_label", F.coalesce("printed_page_label", F.col("page_index").cast("string"), F.lit("?")).alias("label"))


@query("""SELECT d.slug, n.node_kind, n.title, n.ordinal, n.page_from FROM doc_node n JOIN source_document d ON d.id = n.document_id WHERE d.is_current""")
def document_outline(spark, sf):
    t = _t(spark, sf)
    return t("doc_node").join(t("source_document").filter("is_current").select(F.col("id").alias("document_id"), "slug"), "document_id").select("slug", "node_kind", "title", "ordinal", "page_from")


# --- search ---------------------------------------------------------------------------------------------------------
_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def _rank_sql(words: list[str]) -> str:
    asked = "[" + ", ".join(f"'{w}'" for w in words) + "]"
    return f"round(len(list_filter({_WORDS}, lambda w: list_contains({asked}, w))) / (1.0 + ln(greatest(len({_WORDS}), 1))), 6)"


_MATCH = f"(list_contains({_WORDS}, 'courtyard') AND list_contains({_WORDS}, 'embodied') AND list_contains({_WORDS}, 'carbon') AND NOT list_contains({_WORDS}, 'tender'))"


@query(_RETRIEVABLE + f"""SELECT id, document_slug, result_kind, CAST({_rank_sql(['courtyard', 'embodied', 'carbon'])} AS DOUBLE) AS rank FROM r
WHERE {_MATCH} AND has_citation AND placeholder_status IS NULL ORDER BY rank DESC, id LIMIT 200""")
def lexical_topk(spark, sf):
    hits = ranking.lexical(_retrievable(spark, sf).filter("has_citation and not is_placeholder"), SEARCH)
    return ranking.top(hits, "rank", "id").select("id", "document_slug", "result_kind", "rank")


@query(_RETRIEVABLE + f"""SELECT id, 2 AS leg, CAST({_rank_sql(['zzyzx', 'pergola'])} AS DOUBLE) AS rank FROM r WHERE list_contains({_WORDS}, 'zzyzx') OR list_contains({_WORDS}, 'pergola')""")
def lexical_cascade(spark, sf):
    return ranking.cascade(_retrievable(spark, sf), "zzyzx pergola").select("id", "leg", "rank")


@query(_RETRIEVABLE + f"""SELECT id FROM r WHERE contains(' ' || array_to_string({_WORDS}, ' ') || ' ', ' embodied carbon per bay ')""")
def phrase_search(spark, sf):
    return _retrievable(spark, sf).filter(ranking.matches(F.col("text"), '"embodied carbon per bay"')).select("id")


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id,
round(1 - list_sum(list_transform(list_zip(v.embedding, q.e), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(q.e, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS distance
FROM embeddings v, q) SELECT vec_id, distance FROM s ORDER BY distance, vec_id LIMIT 50""")
def vector_topk(spark, sf):
    e = _t(spark, sf)("embeddings")
    asked = e.filter("vec_id = 0").select(F.col("embedding").alias("e"))  # one row
    scored = e.crossJoin(F.broadcast(asked)).select("vec_id", F.round(ranking.cosine_distance(F.col("embedding"), F.col("e")), 6).alias("distance"))
    return ranking.top(scored, "distance", "vec_id", 50, ascending=True).select("vec_id", "distance")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id,
round(1 - list_sum(list_transform(list_zip(v.embedding, q.e), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(q.e, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS distance
FROM embeddings v, q) SELECT query_id, vec_id, distance FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 50""")
def vector_topk_all(spark, sf):
    """The search of vector_topk for every prescribed query."""
    e = _t(spark, sf)("embeddings")
    return ranking.vector_search(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 50).select("query_id", "vec_id", "distance")


@query(f"""WITH lex AS (SELECT doc_id AS id, row_number() OVER (ORDER BY rank DESC, doc_id) AS p FROM (SELECT doc_id, {_rank_sql(['rooflight', 'clerestory'])} AS rank FROM documents
  WHERE list_contains({_WORDS}, 'rooflight') OR list_contains({_WORDS}, 'clerestory')) QUALIFY p <= 200),
q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), vs AS (SELECT vec_id,
  round(1 - list_sum(list_transform(list_zip(v.embedding, q.e), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(q.e, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS d FROM embeddings v, q),
vec AS (SELECT vec_id AS id, row_number() OVER (ORDER BY d, vec_id) AS p FROM vs QUALIFY p <= 200)
SELECT coalesce(lex.id, vec.id) AS id, round(coalesce(1.0 / (60 + lex.p), 0) + coalesce(1.0 / (60 + vec.p), 0), 6)::DOUBLE AS score FROM lex FULL OUTER JOIN vec ON lex.id = vec.id""")
def hybrid_rrf(spark, sf):
    t = _t(spark, sf)
    lex = ranking.top(ranking.lexical(t("documents"), WIDE).select(F.col("doc_id").alias("id"), "rank"), "rank", "id")
    e = t("embeddings")
    asked = e.filter("vec_id = 0").select(F.col("embedding").alias("e"))
    vec = e.crossJoin(F.broadcast(asked)).select(F.col("vec_id").alias("id"), F.round(ranking.cosine_distance(F.col("embedding"), F.col("e")), 6).alias("d"))
    return ranking.fuse(lex, ranking.top(vec, "d", "id", ascending=True), "id").select("id", "score")


@query(f"""WITH lex AS (SELECT doc_id AS id, row_number() OVER (ORDER BY rank DESC, doc_id) AS p FROM (SELECT doc_id, {_rank_sql(['rooflight', 'clerestory'])} AS rank FROM documents
  WHERE list_contains({_WORDS}, 'rooflight') OR list_contains({_WORDS}, 'clerestory')) QUALIFY p <= 200),
q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), vs AS (SELECT query_id, vec_id,
  round(1 - list_sum(list_transform(list_zip(v.embedding, q.e), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(q.e, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS d FROM embeddings v, q),
vec AS (SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS p FROM vs QUALIFY p <= 200),
legs AS (SELECT query_id, id, p FROM lex, (SELECT query_id FROM q))
SELECT query_id, id, round(coalesce(1.0 / (60 + legs.p), 0) + coalesce(1.0 / (60 + vec.p), 0), 6)::DOUBLE AS score FROM legs FULL OUTER JOIN vec USING (query_id, id)""")
def hybrid_rrf_all(spark, sf):
    """The fusion of hybrid_rrf for every prescribed vector."""
    t = _t(spark, sf)
    at = F.struct("query_id", "id").alias("at")
    lex = ranking.top(ranking.lexical(t("documents"), WIDE).select(F.col("doc_id").alias("id"), "rank"), "rank", "id")  # 200 rows at most
    e = t("embeddings")
    asked = e.filter("vec_id % 20 = 0")
    legs = asked.select(F.col("vec_id").alias("query_id")).crossJoin(F.broadcast(lex)).select(at, "place")
    vec = ranking.vector_search(e, asked, "vec_id", "embedding").select("query_id", F.col("vec_id").alias("id"), "place").select(at, "place")
    return ranking.fuse(legs, vec, "at").select("at.query_id", "at.id", "score")


@query(_RETRIEVABLE + f""", h AS (SELECT *, coalesce(knowledge_item_id, asset_id, document_id || ':' || page_from::VARCHAR, document_id) AS result_id, {_rank_sql(['rooflight', 'clerestory'])} AS rank
FROM r WHERE list_contains({_WORDS}, 'rooflight') OR list_contains({_WORDS}, 'clerestory'))
SELECT result_id, result_kind, CAST(max(rank) AS DOUBLE) AS score, bool_or(placeholder_status IS NOT NULL) AS is_placeholder, min(placeholder_status) AS placeholder_status,
arg_max(id, (rank, id)) AS best_chunk, count(*)::BIGINT AS n_chunks FROM h GROUP BY result_id, result_kind, document_id""")
def result_grouping(spark, sf):
    hits = ranking.lexical(_retrievable(spark, sf), WIDE)
    return ranking.group_results(hits).select("result_id", "result_kind", "score", "is_placeholder", "placeholder_status", "best_chunk", "n_chunks")


@query(_RETRIEVABLE + f""", h AS (SELECT *, coalesce(item_type = 'guidance', false) AS ok FROM r WHERE list_contains({_WORDS}, 'rooflight') OR list_contains({_WORDS}, 'clerestory'))
SELECT result_kind, ok, count(*)::BIGINT AS n, (SELECT count(*) FROM h WHERE NOT ok AND result_kind <> 'item')::BIGINT AS suppressed FROM h GROUP BY 1, 2""")
def suppressed_and_kinds(spark, sf):
    hits = _retrievable(spark, sf).filter(ranking.matches(F.col("text"), WIDE)).withColumn("ok", F.coalesce(F.col("item_type") == "guidance", F.lit(False)))
    kinds = hits.groupBy("result_kind", "ok").agg(F.count("*").alias("n"))
    hidden = kinds.agg(F.coalesce(F.sum(F.when(~F.col("ok") & (F.col("result_kind") != "item"), F.col("n"))), F.lit(0)).cast("long").alias("suppressed"))
    return kinds.crossJoin(F.broadcast(hidden))  # one row


@query()
def snippets(spark, sf):
    hits = ranking.lexical(_retrievable(spark, sf), WIDE)
    return hits.select("id", ranking.snippet(F.col("text"), WIDE).alias("snippet"))


@query(_RETRIEVABLE + f"SELECT id, result_kind FROM r WHERE lower(text) LIKE '%whenever%' OR lower(text) LIKE '%step-free%'")
def literal_search(spark, sf):
    return _retrievable(spark, sf).filter(F.col("text").ilike("%whenever%") | F.col("text").ilike("%step-free%")).select("id", "result_kind")


# --- structure ------------------------------------------------------------------------------------------------------
@query("""WITH n AS (SELECT id, document_id, page_from, CASE node_kind WHEN 'volume' THEN 0 WHEN 'chapter' THEN 1 WHEN 'section' THEN 2 ELSE 3 END AS level,
row_number() OVER (PARTITION BY document_id ORDER BY page_from NULLS LAST, ordinal, id) AS seq FROM doc_node)
SELECT id, page_from, CASE WHEN nxt IS NOT NULL THEN greatest(nxt - 1, page_from) END AS page_end FROM (SELECT a.id, a.page_from,
(SELECT b.page_from FROM n b WHERE b.document_id = a.document_id AND b.seq > a.seq AND b.level <= a.level ORDER BY b.seq LIMIT 1) AS nxt FROM n a)""")
def page_ends(spark, sf):
    level = F.when(F.col("node_kind") == "volume", 0).when(F.col("node_kind") == "chapter", 1).when(F.col("node_kind") == "section", 2).otherwise(3)
    w = Window.partitionBy("document_id").orderBy(F.col("page_from").asc_nulls_last(), "ordinal", "id")
    n = _t(spark, sf)("doc_node").withColumns({"level": level, "seq": F.row_number().over(w)})
    return structure.page_ends(n, "document_id", "seq", "level", "page_from").select("id", "page_from", "page_end")


@query("""SELECT id, document_id, last_value(CASE WHEN node_kind IN ('volume', 'chapter') THEN code END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ordinal, id
ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM doc_node""")
def forward_fill(spark, sf):
    n = _t(spark, sf)("doc_node").withColumn("mark", F.when(F.col("node_kind").isin("volume", "chapter"), F.col("code")))
    return structure.forward_fill(n, ["document_id"], ["ordinal", "id"], "mark").select("id", "document_id", "filled")


@query("""WITH j AS (SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) > 1800000000 THEN 1 ELSE 0 END AS jump FROM events)
SELECT event_id, user_id, CAST(sum(jump) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS cluster FROM j""")
def gap_clusters(spark, sf):
    """Runs of a user's events no more than half an hour apart."""
    e = _t(spark, sf)("events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return structure.gap_clusters(e, ["user_id"], ["at", "event_id"], 1_800_000_000).select("event_id", "user_id", "cluster")


_LEVELS = """WITH n AS (SELECT id, document_id, CASE node_kind WHEN 'volume' THEN 0 WHEN 'chapter' THEN 1 WHEN 'section' THEN 2 ELSE 3 END AS level,
row_number() OVER (PARTITION BY document_id ORDER BY page_from NULLS LAST, ordinal, id) AS seq FROM doc_node) """


@query(_LEVELS + """SELECT a.id, (SELECT b.id FROM n b WHERE b.document_id = a.document_id AND b.seq < a.seq AND b.level < a.level ORDER BY b.seq DESC LIMIT 1) AS parent FROM n a""")
def parents_by_level(spark, sf):
    level = F.when(F.col("node_kind") == "volume", 0).when(F.col("node_kind") == "chapter", 1).when(F.col("node_kind") == "section", 2).otherwise(3)
    w = Window.partitionBy("document_id").orderBy(F.col("page_from").asc_nulls_last(), "ordinal", "id")
    n = _t(spark, sf)("doc_node").withColumns({"level": level, "seq": F.row_number().over(w)})
    return structure.parents_by_level(n, "document_id", "seq", "level", "id").select("id", "parent")


@query("""SELECT document_id, content_status, weight FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY weight DESC, content_status NULLS FIRST) AS rn FROM
(SELECT document_id, content_status, sum(length(text))::BIGINT AS weight FROM chunk GROUP BY 1, 2)) WHERE rn = 1""")
def dominant_status(spark, sf):
    return structure.weighted_mode(_t(spark, sf)("chunk"), ["document_id"], "content_status", F.length("text"))


@query("""WITH l AS (SELECT document_id, page_from AS p, min(id) AS label FROM doc_node WHERE page_from IS NOT NULL GROUP BY 1, 2), c AS (SELECT id, document_id, page_index FROM (SELECT DISTINCT * FROM citation) WHERE page_index IS NOT NULL)
SELECT c.id, (SELECT l.label FROM l WHERE l.document_id = c.document_id ORDER BY abs(l.p - c.page_index), l.p LIMIT 1) AS nearest FROM c""")
def nearest_node(spark, sf):
    """The node that begins nearest to each cited page of its document."""
    t = _t(spark, sf)
    labels = t("doc_node").filter("page_from is not null").groupBy("document_id", "page_from").agg(F.min("id").alias("label"))
    points = t("citation").dropDuplicates().filter("page_index is not null").select("id", "document_id", "page_index")
    return structure.nearest_label(points, labels, ["document_id"], "page_index", "page_from", "label").select("id", "nearest")


@query("SELECT document_id, code, arg_min(id, (ordinal, id)) AS id, min(ordinal) AS ordinal FROM doc_node WHERE code IS NOT NULL GROUP BY 1, 2")
def first_sightings(spark, sf):
    n = _t(spark, sf)("doc_node").filter("code is not null").select("document_id", "code", "ordinal", "id")
    return structure.first_sightings(n, ["document_id", "code"], ["ordinal", "id"]).select("document_id", "code", "id", "ordinal")


@query("""SELECT id, document_id FROM (SELECT id, document_id, row_number() OVER (PARTITION BY document_id ORDER BY id) AS turn FROM chunk WHERE asset_id IS NOT NULL)
ORDER BY turn, document_id LIMIT 40""")
def stratified_sample(spark, sf):
    """A round-robin sample of figures over documents (a sampling operator: the limit is its purpose)."""
    return structure.stratified(_t(spark, sf)("chunk").filter("asset_id is not null").select("id", "document_id"), "document_id", "id", 40).select("id", "document_id")


@query("""WITH RECURSIVE w(id, depth) AS (SELECT id, 0 FROM taxonomy_term WHERE parent_id IS NULL UNION ALL SELECT t.id, w.depth + 1 FROM taxonomy_term t JOIN w ON t.parent_id = w.id)
SELECT id, depth FROM w""")
def tree_depth(spark, sf):
    return structure.recursive_depths(_t(spark, sf)("taxonomy_term"))


@query("""WITH RECURSIVE w(id, depth) AS (SELECT id, 0 FROM criterion WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM criterion) UNION ALL
SELECT t.id, w.depth + 1 FROM criterion t JOIN w ON t.parent_id = w.id) SELECT c.id AS node_id, w.depth AS level FROM criterion c LEFT JOIN w ON w.id = c.id""")
def topological_order(spark, sf):
    return structure.topological(_t(spark, sf)("criterion"), F.lit("c")).select("node_id", "level")


@query("SELECT id, path, row_number() OVER (ORDER BY taxonomy_id, string_split(path, '.'), id) AS place FROM taxonomy_term WHERE path IS NOT NULL")
def order_by_path(spark, sf):
    """Paths compare label by label; the table is a controlled vocabulary of fixed size, so one global order is fine."""
    w = Window.orderBy("taxonomy_id", F.split("path", r"\."), "id")
    return _t(spark, sf)("taxonomy_term").filter("path is not null").select("id", "path", F.row_number().over(w).cast("long").alias("place"))


# --- text and values ------------------------------------------------------------------------------------------------
@query(r"""SELECT id, len(regexp_extract_all(text, '[\p{L}\p{N}_]{1,3}|[^\p{L}\p{N}_\s\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1680}]'))::INTEGER AS tokens FROM chunk""")
def token_estimate(spark, sf):
    return _t(spark, sf)("chunk").select("id", T.token_count(F.col("text")).alias("tokens"))


_FILL = "[" + ", ".join(f"'{w}'" for w in T.FILLER_WORDS) + "]"


@query(rf"""WITH w AS (SELECT id, text, regexp_extract_all(lower(text), '[a-z]+') AS words FROM chunk)
SELECT id, CASE WHEN regexp_matches(text, '(^|[^A-Za-z0-9_À-ɏ])WIP($|[^A-Za-z0-9_À-ɏ])') THEN 'wip' WHEN regexp_matches(text, '(?i)template\s*\n?\s*only') THEN 'template'
WHEN regexp_matches(text, '(?i)lorem\s+ipsum') THEN 'lorem' WHEN len(words) >= 150 AND len(list_filter(words, lambda w: list_contains({_FILL}, w))) > 0.12 * len(words) THEN 'lorem' ELSE 'real' END AS status FROM w""")
def page_status(spark, sf):
    return _t(spark, sf)("chunk").select("id", T.page_status(F.col("text")).alias("status"))


@query(r"""SELECT knowledge_item_id, value_text, regexp_matches(trim(value_text), '(?i)^X\s*(%|km|no)') AS is_placeholder_value FROM benchmark""")
def placeholder_values(spark, sf):
    return _t(spark, sf)("benchmark").select("knowledge_item_id", "value_text", T.is_placeholder_value(F.col("value_text")).alias("is_placeholder_value"))


_NUM = r"(-?\d+(?:\.\d+)?)"
_UNIT = r"((?:[%a-zA-Zµ°²·](?:[%a-zA-Z0-9µ°²·/]|\.[%a-zA-Zµ°²·])*)?)"


@query(rf"""WITH v AS (SELECT knowledge_item_id, target_text AS t FROM requirement UNION ALL SELECT knowledge_item_id, value_text FROM benchmark),
c AS (SELECT knowledge_item_id, t, regexp_replace(trim(t), '[\s*]*\*$', '') AS b FROM v WHERE t IS NOT NULL),
f AS (SELECT *, CASE WHEN regexp_matches(trim(t), '(?i)^X\s*(%|km|no)') THEN NULL WHEN regexp_matches(b, '(?:^|[^A-Za-z0-9_.]){_NUM}\s*-\s*{_NUM}') THEN 'range'
  WHEN regexp_matches(b, '[<≤]\s*{_NUM}') THEN 'lte' WHEN regexp_matches(b, '[>≥]\s*{_NUM}') THEN 'gte' WHEN regexp_matches(b, '{_NUM}\s*%') THEN 'pct'
  WHEN regexp_matches(b, '^{_NUM}\s*{_UNIT}$') THEN 'whole' END AS form FROM c)
SELECT knowledge_item_id, t AS value_text, CASE WHEN form IN ('pct', 'whole') OR form IS NULL THEN 'none' ELSE form END AS comparator,
CASE form WHEN 'lte' THEN regexp_extract(b, '[<≤]\s*{_NUM}', 1) WHEN 'gte' THEN regexp_extract(b, '[>≥]\s*{_NUM}', 1) WHEN 'pct' THEN regexp_extract(b, '{_NUM}\s*%', 1)
  WHEN 'whole' THEN regexp_extract(b, '^{_NUM}', 1) END::DOUBLE AS number,
CASE WHEN form = 'range' THEN regexp_extract(b, '(?:^|[^A-Za-z0-9_.]){_NUM}\s*-\s*{_NUM}', 1) END::DOUBLE AS minimum,
CASE WHEN form = 'range' THEN regexp_extract(b, '(?:^|[^A-Za-z0-9_.]){_NUM}\s*-\s*{_NUM}', 2) END::DOUBLE AS maximum,
regexp_matches(trim(t), '\*$') AS has_caveat, form IS NOT NULL AS parsed_ok FROM f""")
def value_parse(spark, sf):
    """Numbers, comparator and caveat of every target and benchmark text."""
    t = _t(spark, sf)
    v = t("requirement").select("knowledge_item_id", F.col("target_text").alias("value_text")).unionByName(t("benchmark").select("knowledge_item_id", "value_text"))
    p = values.parse_values(v.filter("value_text is not null"), "value_text", out="p")
    return p.select("knowledge_item_id", "value_text", "p.comparator", F.col("p.numeric").alias("number"), "p.minimum", "p.maximum", F.col("p.caveat_text").isNotNull().alias("has_caveat"), "p.parsed_ok")


@query("""WITH p AS (SELECT document_id, page_from AS page, content_status, string_agg(text, chr(10) ORDER BY ordinal, id) AS text FROM chunk
  WHERE knowledge_item_id IS NULL AND asset_id IS NULL AND page_from IS NOT NULL GROUP BY 1, 2, 3)
SELECT document_id, page, 'guidance' AS item_type, length(substring(b, 1, 4000))::INTEGER AS n_chars FROM (SELECT *, trim(regexp_replace(text, '[\\s\\x{a0}]+', ' ', 'g')) AS b, regexp_extract_all(lower(text), '[a-z]+') AS words FROM p)
WHERE (content_status IS NULL OR content_status NOT IN ('lorem','template','wip','draft')) AND length(b) >= 40 AND NOT regexp_matches(text, '(^|[^A-Za-z0-9_À-ɏ])WIP($|[^A-Za-z0-9_À-ɏ])')
AND NOT regexp_matches(text, '(?i)template\\s*\\n?\\s*only') AND NOT regexp_matches(text, '(?i)lorem\\s+ipsum') AND NOT (len(words) >= 150 AND len(list_filter(words, lambda w: list_contains(@FILL@, w))) > 0.12 * len(words))""".replace("\\\\", "\\").replace("@FILL@", _FILL))
def extract_generic(spark, sf):
    """Guidance items from the pages of every document, through the registry of extractors."""
    t = _t(spark, sf)
    pages = t("chunk").filter("knowledge_item_id is null and asset_id is null and page_from is not null").groupBy("document_id", F.col("page_from").alias("page"), "content_status").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    kinds = t("source_document").select(F.col("id").alias("document_id"), "doc_kind")
    items = extraction.extract(pages.join(kinds, "document_id", "left"))
    return items.select("document_id", "page", "item_type", F.length("statement").alias("n_chars"))


@query("""WITH s AS (SELECT knowledge_item_id, min(page_index) AS page_from, max(page_index) AS page_to FROM citation GROUP BY 1)
SELECT k.id AS knowledge_item_id, s.page_from, s.page_to, CASE WHEN k.statement IS NOT NULL THEN concat_ws(chr(10) || chr(10), nullif(trim(k.title), ''), nullif(trim(k.statement), ''))
ELSE coalesce(nullif(trim(k.summary), ''), nullif(trim(k.title), ''), '[' || k.item_type || ']') END AS text FROM knowledge_item k LEFT JOIN s ON s.knowledge_item_id = k.id""")
def item_chunks(spark, sf):
    t = _t(spark, sf)
    return extraction.item_chunks(t("knowledge_item"), t("citation")).select("knowledge_item_id", "page_from", "page_to", "text")


@query("""SELECT DISTINCT document_id, page_from AS page FROM chunk c WHERE page_from IS NOT NULL AND NOT EXISTS (SELECT 1 FROM citation x WHERE x.document_id = c.document_id AND x.page_index = c.page_from)""")
def uncovered_pages(spark, sf):
    t = _t(spark, sf)
    pages = t("chunk").filter("page_from is not null").select("document_id", F.col("page_from").alias("page")).distinct()
    return extraction.uncovered_pages(pages, t("citation"))


@query(r"""SELECT id, coalesce(nullif(trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'x') AS slug, trim(regexp_replace(code, '[_-]+', ' ', 'g')) AS human,
CASE WHEN length(label) > 40 THEN substring(label, 1, 40) || '… [truncated, ' || length(label) || ' chars total]' ELSE label END AS short,
CASE WHEN regexp_matches(regexp_replace(code, '[^A-Za-z0-9_]', '_', 'g'), '^[0-9]') THEN 'n' ELSE '' END || regexp_replace(code, '[^A-Za-z0-9_]', '_', 'g') AS label_key FROM taxonomy_term""")
def text_functions(spark, sf):
    return _t(spark, sf)("taxonomy_term").select(
        "id", T.slugify(F.col("label")).alias("slug"), T.humanise(F.col("code")).alias("human"), T.truncate_text(F.col("label"), 40).alias("short"), T.path_label(F.col("code")).alias("label_key"))


@query("""SELECT k.id, CASE WHEN s <> '' THEN s ELSE '[' || k.item_type || ']' END AS text FROM (SELECT k.id, k.item_type,
concat_ws(chr(10), nullif(k.base, ''), CASE WHEN m.name IS NOT NULL AND NOT contains(lower(k.base), lower(m.name)) THEN 'metric: ' || m.name END,
CASE WHEN b.value_text IS NOT NULL AND NOT contains(lower(k.base), lower(trim(regexp_replace(b.value_text, '[ ]+', ' ', 'g')))) THEN 'value: ' || trim(regexp_replace(b.value_text, '[ ]+', ' ', 'g')) END) AS s
FROM (SELECT id, item_type, trim(regexp_replace(concat_ws(' ', title, statement), '\\s+', ' ', 'g')) AS base FROM knowledge_item) k
LEFT JOIN (SELECT knowledge_item_id, min(metric_id) AS metric_id, min(value_text) AS value_text FROM benchmark GROUP BY 1) b ON b.knowledge_item_id = k.id LEFT JOIN metric m ON m.id = b.metric_id) k""".replace("\\\\s", "\\s"))
def compose_chunk_text(spark, sf):
    t = _t(spark, sf)
    b = t("benchmark").groupBy(F.col("knowledge_item_id").alias("id")).agg(F.min("metric_id").alias("metric_id"), F.min("value_text").alias("value_text"))
    rows = t("knowledge_item").select("id", "item_type", "title", "statement").join(b, "id", "left").join(
        t("metric").select(F.col("id").alias("metric_id"), F.col("name").alias("metric_name")), "metric_id", "left")
    return rows.select("id", enrich.compose(F.concat_ws(" ", "title", "statement"), [("metric", F.col("metric_name")), ("value", F.col("value_text"))], F.col("item_type")).alias("text"))


#: phrases of the lexicon that tags items (examples of the vocabulary, not a fixed list)
LEXICON = [("daylight", "topic.light", 0.75), ("glare", "topic.light", 0.55), ("embodied carbon", "topic.carbon", 0.75), ("reuse", "topic.carbon", 0.4), ("stormwater", "topic.water", 0.75),
           ("rain garden", "topic.water", 0.55), ("acoustic", "topic.noise", 0.55), ("quiet rooms", "topic.noise", 0.75)]
_LEX_SQL = " UNION ALL ".join(f"SELECT id AS item_id, '{t}' AS term_id, {c} AS confidence FROM knowledge_item WHERE regexp_matches(statement, '(?i)(^|[^A-Za-z0-9_]){p}($|[^A-Za-z0-9_])')" for p, t, c in LEXICON)


@query(f"SELECT item_id, term_id, max(confidence)::DOUBLE AS confidence FROM ({_LEX_SQL}) GROUP BY 1, 2")
def keyword_tags(spark, sf):
    return enrich.keyword_tags(_t(spark, sf)("knowledge_item"), "id", "statement", LEXICON)


@query(f"""WITH tags AS (SELECT item_id, term_id, 'keyword' AS rule, 2 AS rule_no, max(confidence) AS confidence FROM ({_LEX_SQL}) GROUP BY 1, 2
UNION ALL SELECT DISTINCT k.id, 'topic.light', 'metric', 1, 0.75 FROM knowledge_item k JOIN benchmark b ON b.knowledge_item_id = k.id WHERE b.metric_id IN ('daylight_factor', 'illuminance'))
SELECT item_id, term_id, rule, confidence::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY item_id, term_id ORDER BY confidence DESC, rule_no) AS rn FROM tags) WHERE rn = 1""")
def facet_classifier(spark, sf):
    """Tags from structure and from words; the surest rule per item and term."""
    t = _t(spark, sf)
    words = enrich.keyword_tags(t("knowledge_item"), "id", "statement", LEXICON).select("item_id", "term_id", F.lit("keyword").alias("rule"), F.lit(2).alias("rule_no"), "confidence")
    metric = t("benchmark").filter(F.col("metric_id").isin("daylight_factor", "illuminance")).select(F.col("knowledge_item_id").alias("item_id")).distinct().select(
        "item_id", F.lit("topic.light").alias("term_id"), F.lit("metric").alias("rule"), F.lit(1).alias("rule_no"), F.lit(0.75).alias("confidence"))
    return enrich.prefer_surest(words.unionByName(metric))


@query(r"""WITH named AS (SELECT DISTINCT id AS item_id, document_id, unnest(regexp_extract_all(text, '[0-9]+\.[0-9]+(?:\.[0-9]+)?')) AS code FROM chunk)
SELECT n.item_id, n.code, c.id AS target_id, 0.9::DOUBLE AS confidence FROM named n JOIN doc_node c ON c.code = n.code AND c.document_id = n.document_id""")
def code_links(spark, sf):
    """Chunks to the sections of their own document that they name."""
    t = _t(spark, sf)
    return enrich.code_links(t("chunk"), "id", "text", t("doc_node").select("document_id", "code", F.col("id").alias("target_id")), r"[0-9]+\.[0-9]+(?:\.[0-9]+)?", "document_id")


@query("""WITH r AS (SELECT id AS ref_id, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS w FROM knowledge_item WHERE item_type = 'guidance'),
d AS (SELECT id AS document_id, unnest(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+'))) AS word FROM source_document),
e AS (SELECT ref_id, len(w) AS n, unnest(w) AS word FROM r WHERE len(w) >= 2), h AS (SELECT e.ref_id, d.document_id, e.n, count(*) AS hits FROM e JOIN d USING (word) GROUP BY 1, 2, 3),
s AS (SELECT *, round(hits / n, 6) AS overlap FROM h)
SELECT ref_id, document_id, overlap::DOUBLE AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY overlap DESC, document_id) AS rn FROM s WHERE overlap >= 0.6) WHERE rn = 1""")
def reference_resolution(spark, sf):
    t = _t(spark, sf)
    refs = t("knowledge_item").filter("item_type = 'guidance'").select(F.col("id").alias("ref_id"), F.col("title").alias("raw_text"))
    return enrich.resolve_references(refs, t("source_document").select(F.col("id").alias("document_id"), "title"))


def flagship(spark, sf) -> DataFrame:
    return lexical_topk(spark, sf)
