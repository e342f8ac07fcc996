"""Queries over the document knowledge base, continued: search over chunk vectors, grids, maps, references, decisions, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import audit, enrich, merge, ranking, structure
from lodestack.plans import kb_queries as kb
from lodestack.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _t(spark, sf):
    return lambda name: table(spark, sf, name)


_USABLE = "len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


@query(kb._RETRIEVABLE + f""", open AS (SELECT r.*, {kb._rank_sql(['rooflight', 'clerestory'])} AS rank FROM r JOIN source_document d ON d.id = r.document_id WHERE r.placeholder_status IS NULL AND r.result_kind = 'item' AND d.is_current),
e AS (SELECT id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM chunk WHERE {_USABLE}), asked AS (SELECT e FROM e ORDER BY id LIMIT 1),
lex AS (SELECT id, row_number() OVER (ORDER BY rank DESC, id) AS p FROM open WHERE list_contains({kb._WORDS}, 'rooflight') OR list_contains({kb._WORDS}, 'clerestory') QUALIFY p <= 200),
far AS (SELECT o.id, round(1 - list_cosine_similarity(e.e, a.e), 6) AS d FROM open o JOIN e ON e.id = o.id, asked a), vec AS (SELECT id, row_number() OVER (ORDER BY d, id) AS p FROM far QUALIFY p <= 200),
f AS (SELECT coalesce(lex.id, vec.id) AS id, round(coalesce(1.0 / (60 + lex.p), 0) + coalesce(1.0 / (60 + vec.p), 0), 6)::DOUBLE AS score FROM lex FULL OUTER JOIN vec ON lex.id = vec.id)
SELECT f.id, f.score, o.document_slug, o.title, o.page_from FROM f JOIN open o ON o.id = f.id ORDER BY f.score DESC, f.id LIMIT 50""")
def hybrid_search(spark, sf):
    """Word and vector legs over the retrievable items of current documents, policy and facets inside each leg; fused, limited, then hydrated."""
    t = _t(spark, sf)
    current = t("source_document").filter("is_current").select(F.col("id").alias("document_id"))
    view = kb._retrievable(spark, sf).filter("placeholder_status is null and result_kind = 'item'").drop("is_current").join(current, "document_id", "left_semi")
    usable = F.exists("e", lambda x: x != 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    vectors = t("chunk").filter(F.size("embedding") == 384).select("id", F.col("embedding").cast("array<double>").alias("e")).filter(usable)
    asked = vectors.orderBy("id").limit(1).select(F.col("e").alias("asked"))  # one row
    lex = ranking.top(ranking.lexical(view, kb.WIDE).select("id", "rank"), "rank", "id")
    near = vectors.join(view.select("id"), "id", "left_semi").crossJoin(F.broadcast(asked)).select("id", F.round(ranking.cosine_distance(F.col("e"), F.col("asked")), 6).alias("d"))
    best = ranking.fuse(lex, ranking.top(near, "d", "id", ascending=True), "id").select("id", "score").orderBy(F.desc("score"), "id").limit(50)
    return best.join(view.select("id", "document_slug", "title", "page_from"), "id")


_LIVE = "FROM requirement q JOIN knowledge_item k ON k.id = q.knowledge_item_id WHERE k.review_status <> 'rejected'"


@query(f"""WITH live AS (SELECT q.criterion_id, q.knowledge_item_id, CASE WHEN q.requirement_kind IN ('graded', 'compliance') THEN q.requirement_kind END AS level {_LIVE}),
cell AS (SELECT criterion_id, level, list(knowledge_item_id ORDER BY knowledge_item_id) AS items FROM live GROUP BY 1, 2),
of AS (SELECT DISTINCT c.framework_id FROM live l JOIN criterion c ON c.id = l.criterion_id WHERE l.level IS NULL)
SELECT c.id, c.framework_id, c.code, CAST(to_json(coalesce(g.items, [])) AS VARCHAR) AS graded, CAST(to_json(coalesce(o.items, [])) AS VARCHAR) AS compliance, CAST(to_json(coalesce(u.items, [])) AS VARCHAR) AS unassigned,
c.framework_id IN (SELECT framework_id FROM of) AS has_unassigned FROM criterion c LEFT JOIN cell g ON g.criterion_id = c.id AND g.level = 'graded'
LEFT JOIN cell o ON o.criterion_id = c.id AND o.level = 'compliance' LEFT JOIN cell u ON u.criterion_id = c.id AND u.level IS NULL""")
def matrix_unassigned(spark, sf):
    """Criteria by the levels of a scale, every cell an array; requirements of no level or one foreign to the scale stand under unassigned."""
    t = _t(spark, sf)
    live = t("knowledge_item").filter("review_status <> 'rejected'").select(F.col("id").alias("knowledge_item_id"))
    cells = t("requirement").select("criterion_id", "knowledge_item_id", F.col("requirement_kind").alias("level")).join(live, "knowledge_item_id", "left_semi")
    grid = structure.matrix(t("criterion").select("id", "framework_id", "code"), cells.withColumnRenamed("criterion_id", "id"), "id", "level", ["graded", "compliance"], "knowledge_item_id")
    some = grid.groupBy("framework_id").agg(F.bool_or(F.size("unassigned") > 0).alias("has_unassigned"))
    as_text = [F.to_json(c).alias(c) for c in ("graded", "compliance", "unassigned")]
    return grid.join(some, "framework_id").select("id", "framework_id", "code", *as_text, "has_unassigned")


@query(kb._RETRIEVABLE + """SELECT document_id, CAST(to_json(map_from_entries(list((result_kind, n) ORDER BY result_kind))) AS VARCHAR) AS kinds, CAST(sum(n) AS BIGINT) AS total FROM
(SELECT document_id, result_kind, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1""")
def kind_histogram(spark, sf):
    """How many results of each kind a document has, as a map."""
    n = kb._retrievable(spark, sf).groupBy("document_id", "result_kind").agg(F.count("*").alias("n"))
    return n.groupBy("document_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("result_kind", "n"))))).alias("kinds"), F.sum("n").alias("total"))


@query("""SELECT (SELECT CAST(to_json(list({'doc_kind': doc_kind, 'n': n} ORDER BY doc_kind)) AS VARCHAR) FROM (SELECT doc_kind, count(*) AS n FROM source_document GROUP BY 1)) AS documents,
(SELECT CAST(to_json(list({'item_type': item_type, 'n': n} ORDER BY item_type)) AS VARCHAR) FROM (SELECT item_type, count(*) AS n FROM knowledge_item WHERE review_status <> 'rejected' GROUP BY 1)) AS items,
(SELECT CAST(to_json(list({'taxonomy_id': taxonomy_id, 'n': n} ORDER BY taxonomy_id)) AS VARCHAR) FROM (SELECT taxonomy_id, count(*) AS n FROM taxonomy_term GROUP BY 1)) AS terms,
(SELECT count(*) FROM citation)::BIGINT AS n_citations, (SELECT coalesce(sum(page_count), 0) FROM source_document)::BIGINT AS n_pages""")
def facet_options(spark, sf):
    """One row for a filter panel: options with their counts, and totals; every part is an aggregate of its own."""
    t = _t(spark, sf)

    def options(df, key: str, name: str):
        n = df.groupBy(key).agg(F.count("*").alias("n"))
        return n.agg(F.to_json(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name))

    parts = [options(t("source_document"), "doc_kind", "documents"), options(t("knowledge_item").filter("review_status <> 'rejected'"), "item_type", "items"),
             options(t("taxonomy_term"), "taxonomy_id", "terms"), t("citation").agg(F.count("*").alias("n_citations")),
             t("source_document").agg(F.coalesce(F.sum("page_count"), F.lit(0)).cast("long").alias("n_pages"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


_REFS = "SELECT id AS ref_id, CASE item_type WHEN 'guidance' THEN 'page' WHEN 'role' THEN 'sibling_doc' WHEN 'pattern' THEN 'module_chapter' ELSE 'other' END AS ref_kind, title AS raw_text FROM knowledge_item"


@query(f"""WITH f AS ({_REFS}), r AS (SELECT ref_id, list_distinct(regexp_extract_all(lower(raw_text), '[a-z0-9]+')) AS w FROM f),
d AS (SELECT id AS document_id, unnest(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+'))) AS word FROM source_document),
e AS (SELECT ref_id, len(w) AS n, unnest(w) AS word FROM r WHERE len(w) >= 2), h AS (SELECT e.ref_id, d.document_id, e.n, count(*) AS hits FROM e JOIN d USING (word) GROUP BY 1, 2, 3),
b AS (SELECT ref_id, document_id FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY round(hits / n, 6) DESC, document_id) AS rn FROM h WHERE round(hits / n, 6) >= 0.6) WHERE rn = 1)
SELECT f.ref_id, CASE WHEN b.document_id IS NOT NULL THEN 'resolved' WHEN f.ref_kind = 'sibling_doc' OR (f.ref_kind IN ('module_chapter', 'page') AND regexp_matches(f.raw_text, '(?i)\\bmodule\\s+[0-9]')) THEN 'missing_source'
ELSE 'unresolved' END AS resolution, b.document_id FROM f LEFT JOIN b ON b.ref_id = f.ref_id""")
def reference_states(spark, sf):
    """Titles of items as references: resolved in the corpus, of a source that is missing, or open."""
    t = _t(spark, sf)
    kind = F.when(F.col("item_type") == "guidance", "page").when(F.col("item_type") == "role", "sibling_doc").when(F.col("item_type") == "pattern", "module_chapter").otherwise("other")
    refs = t("knowledge_item").select(F.col("id").alias("ref_id"), kind.alias("ref_kind"), F.col("title").alias("raw_text"))
    return enrich.reference_states(refs, t("source_document").select(F.col("id").alias("document_id"), "title"))


@query("""WITH p AS (SELECT id, regexp_extract_all(code, '[.-]?[^.-]+') AS parts FROM criterion WHERE code IS NOT NULL),
c AS (SELECT id, len(parts) - i AS cut_off, array_to_string(parts[1:i], '') AS code FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM p)),
t AS (SELECT code, min(id) AS term_id FROM criterion WHERE code IS NOT NULL AND parent_id IS NULL GROUP BY 1)
SELECT id AS item_id, term_id, 0.95::DOUBLE AS confidence FROM c JOIN t USING (code) QUALIFY row_number() OVER (PARTITION BY id ORDER BY cut_off, term_id) = 1""")
def code_prefix_tags(spark, sf):
    """Each criterion's tag: the root whose code is the longest prefix of its own, walking up level by level."""
    c = _t(spark, sf)("criterion").filter("code is not null")
    roots = c.filter("parent_id is null").groupBy("code").agg(F.min("id").alias("term_id"))
    return enrich.prefix_tags(c, "id", "code", roots)


@query("""SELECT id, CASE WHEN review_status = 'pending' AND extraction_confidence >= 0.9 THEN 'approved' WHEN review_status = 'pending' AND extraction_confidence < 0.5 THEN 'rejected' ELSE review_status END AS review_status,
CASE WHEN review_status = 'pending' AND (extraction_confidence >= 0.9 OR extraction_confidence < 0.5) THEN true ELSE reviewed_at IS NOT NULL END AS is_reviewed FROM knowledge_item""")
def review_decisions(spark, sf):
    """Decisions on pending items set their status and the time of review; others stay."""
    k = _t(spark, sf)("knowledge_item").select("id", "review_status", "reviewed_at", "extraction_confidence")
    verdict = F.when(F.col("extraction_confidence") >= 0.9, "approved").when(F.col("extraction_confidence") < 0.5, "rejected")
    decided = k.filter("review_status = 'pending'").select("id", verdict.alias("decision")).filter("decision is not null")
    return merge.decide(k.drop("extraction_confidence"), decided, F.lit("2025-01-01").cast("timestamp")).select("id", "review_status", F.col("reviewed_at").isNotNull().alias("is_reviewed"))


@query("""SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'unlisted' WHEN a.sha256 IS DISTINCT FROM b.sha256 THEN 'changed' ELSE 'same' END AS state
FROM (SELECT DISTINCT id, sha256 FROM source_document) a FULL JOIN (SELECT DISTINCT id, sha256 FROM source_document_replica) b ON a.id = b.id""")
def manifest_drift(spark, sf):
    """A manifest of contents against what is there."""
    t = _t(spark, sf)
    return audit.manifest_drift(t("source_document").select("id", "sha256"), t("source_document_replica").select("id", "sha256"), "id", "sha256")


@query("""SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) > 20""")
def prune_jobs(spark, sf):
    """What goes when each user keeps the 20 newest."""
    return merge.beyond_newest(_t(spark, sf)("events"), ["user_id"], ["ts", "event_id"], 20).select("event_id", "user_id")


@query("""SELECT id, CASE WHEN parent_id IN (SELECT id FROM doc_node) THEN parent_id END AS parent_id FROM doc_node""")
def orphan_links_cleared(spark, sf):
    """Deleting with SET NULL: links to rows that are gone become null."""
    n = _t(spark, sf)("doc_node").select("id", "parent_id")
    return merge.clear_orphans(n, n.select("id"), "parent_id")


@query("""SELECT id, concat(upper(left(h, 1)), substring(h, 2)) AS title, length(h)::INTEGER AS n_chars, CAST(DATE '1899-12-30' + page_count AS VARCHAR) AS serial_date FROM
(SELECT id, page_count, trim(regexp_replace(replace(slug, chr(0), ''), '[_-]+', ' ', 'g')) AS h FROM source_document)""")
def slug_titles(spark, sf):
    d = _t(spark, sf)("source_document")
    h = T.title_of_slug(T.without_nul(F.col("slug")))
    return d.select("id", h.alias("title"), F.length(h).alias("n_chars"), T.date_of_serial(F.col("page_count")).cast("string").alias("serial_date"))
