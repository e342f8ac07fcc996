"""Queries over writing, audit, events and the star schema: merges, revisions, fingerprints, jobs, catalogues."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.operators import audit, merge
from lodestack.sources.tables import table
from lodestack.streaming import ingest

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _t(spark: SparkSession, sf: str):
    return lambda name: table(spark, sf, name)


# --- merges ---------------------------------------------------------------------------------------------------------
@query("""WITH n AS (SELECT id, min(title) AS title, min(content_status) AS content_status FROM (SELECT * FROM knowledge_item_replica) GROUP BY 1),
o AS (SELECT id, title, content_status FROM knowledge_item)
SELECT coalesce(o.id, n.id) AS id, coalesce(n.title, o.title) AS title, coalesce(n.content_status, o.content_status) AS content_status FROM o FULL OUTER JOIN n ON o.id = n.id""")
def upsert_coalesce(spark, sf):
    """The replica's rows written over the primary ones, nulls leaving what is there."""
    t = _t(spark, sf)
    new = t("knowledge_item_replica").groupBy("id").agg(F.min("title").alias("title"), F.min("content_status").alias("content_status"))
    return merge.upsert(t("knowledge_item").select("id", "title", "content_status"), new, ["id"])


@query("""WITH n AS (SELECT code, framework_id, id, CASE WHEN ordinal % 2 = 0 THEN code ELSE upper(title_primary) END AS title_primary FROM criterion)
SELECT o.id, o.code, CASE WHEN n.title_primary IS DISTINCT FROM o.code THEN n.title_primary ELSE o.title_primary END AS title_primary FROM criterion o JOIN n ON n.id = o.id""")
def upsert_titles(spark, sf):
    """A title that is only the bare code never replaces a real one."""
    c = _t(spark, sf)("criterion").select("id", "code", "title_primary", "ordinal")
    new = c.select("id", "code", F.when(F.col("ordinal") % 2 == 0, F.col("code")).otherwise(F.upper("title_primary")).alias("title_primary"))
    return merge.upsert(c.drop("ordinal"), new, ["id"], {"title_primary": "code"})


@query("SELECT id, slug FROM source_document UNION ALL SELECT DISTINCT id, slug FROM source_document_replica r WHERE NOT EXISTS (SELECT 1 FROM source_document d WHERE d.id = r.id)")
def insert_missing(spark, sf):
    t = _t(spark, sf)
    return merge.insert_missing(t("source_document").select("id", "slug"), t("source_document_replica").select("id", "slug"), ["id"])


@query("SELECT DISTINCT slug FROM documents d WHERE slug IS NOT NULL AND NOT EXISTS (SELECT 1 FROM source_document s WHERE s.slug = d.slug)")
def stub_keys(spark, sf):
    t = _t(spark, sf)
    return merge.stubs(t("documents"), t("source_document"), "slug", "slug")


@query("""WITH w AS (SELECT id, min(title) AS v FROM source_document_replica GROUP BY 1)
SELECT coalesce(w.id, e.id) AS id, w.v AS new_value, e.title AS old_value,
CASE WHEN e.id IS NULL THEN 'insert' WHEN w.id IS NULL THEN 'stale' WHEN w.v IS NOT DISTINCT FROM e.title THEN 'keep' ELSE 'rewrite' END AS action FROM w FULL OUTER JOIN source_document e ON e.id = w.id""")
def reconcile_plan(spark, sf):
    t = _t(spark, sf)
    wanted = t("source_document_replica").groupBy("id").agg(F.min("title").alias("title"))
    return merge.reconcile(wanted, t("source_document"), ["id"], "title")


@query("""SELECT id, slug, row_number() OVER w::INTEGER AS revision_no, lag(id) OVER w AS supersedes, lead(id) OVER w IS NULL AS current FROM source_document
WINDOW w AS (PARTITION BY slug ORDER BY ingested_at NULLS FIRST, id)""".replace("row_number() OVER w::INTEGER", "CAST(row_number() OVER w AS INTEGER)"))
def revision_chain(spark, sf):
    return merge.revisions(_t(spark, sf)("source_document")).select("id", "slug", "revision_no", "supersedes", "current")


@query("""SELECT doc_id, sha256(text) AS digest, min(doc_id) OVER (PARTITION BY text) AS first_id, count(*) OVER (PARTITION BY text)::BIGINT AS n_copies FROM documents WHERE text IS NOT NULL""")
def content_dedup(spark, sf):
    return merge.content_duplicates(_t(spark, sf)("documents"), "text", "doc_id").select("doc_id", "digest", "first_id", "n_copies")


@query("""SELECT id, document_id, text FROM chunk WHERE document_id NOT IN (SELECT document_id FROM doc_node WHERE node_kind = 'matrix') OR asset_id IS NOT NULL
UNION ALL SELECT id || '#2', document_id, 'v2 ' || text FROM chunk WHERE document_id IN (SELECT document_id FROM doc_node WHERE node_kind = 'matrix') AND asset_id IS NULL""")
def replace_document_chunks(spark, sf):
    """Chunks of some documents rewritten as a whole, figures spared."""
    t = _t(spark, sf)
    touched = t("doc_node").filter("node_kind = 'matrix'").select("document_id").distinct()
    old = t("chunk").select("id", "document_id", "text", "asset_id")
    new = old.filter("asset_id is null").join(touched, "document_id", "left_semi").select(
        F.concat("id", F.lit("#2")).alias("id"), "document_id", F.concat(F.lit("v2 "), "text").alias("text"), "asset_id")
    return merge.replace_groups(old, new, "document_id", F.col("asset_id").isNotNull(), touched).select("id", "document_id", "text")


@query("SELECT id, knowledge_item_id FROM citation WHERE knowledge_item_id IN (SELECT id FROM knowledge_item WHERE review_status <> 'rejected')")
def cascade_delete(spark, sf):
    t = _t(spark, sf)
    return merge.without_orphans(t("citation").select("id", "knowledge_item_id"), t("knowledge_item").filter("review_status <> 'rejected'"), "knowledge_item_id")


@query("""SELECT k.document_id, count(*)::BIGINT AS n_old, count(*) FILTER (WHERE k.review_status = 'approved')::BIGINT AS n_protected, coalesce(max(r.n), 0)::BIGINT AS n_new,
CASE WHEN coalesce(max(r.n), 0) = 0 THEN 'would be empty' ELSE 'would lose reviewed rows' END AS reason FROM knowledge_item k
LEFT JOIN (SELECT document_id, count(*) AS n FROM knowledge_item_replica GROUP BY 1) r ON r.document_id = k.document_id GROUP BY 1 HAVING coalesce(max(r.n), 0) = 0 OR count(*) FILTER (WHERE k.review_status = 'approved') > 0""")
def replacement_guard(spark, sf):
    t = _t(spark, sf)
    return merge.replacement_guard(t("knowledge_item"), t("knowledge_item_replica"), "document_id", F.col("review_status") == "approved")


@query("SELECT id FROM taxonomy_term WHERE id IN (SELECT building_use_id FROM benchmark) OR id IN (SELECT region_id FROM benchmark)")
def terms_in_use(spark, sf):
    t = _t(spark, sf)
    return merge.either_key(t("taxonomy_term"), t("benchmark"), "building_use_id", "region_id", "id").select("id")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_event(spark, sf):
    return merge.latest(_t(spark, sf)("events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


# --- audit ----------------------------------------------------------------------------------------------------------
def _digest_sql(name: str, columns: list[str]) -> str:
    row = "concat_ws('|', " + ", ".join(f"coalesce({c}::VARCHAR, '∅')" for c in sorted(columns)) + ")"
    return f"""SELECT '{name}' AS name, count(*)::BIGINT AS n_rows, (coalesce(sum(('0x' || substring(md5({row}), 1, 15))::UBIGINT::HUGEINT), 0) % 1000000000000000000)::BIGINT AS digest FROM {name}"""


_PRINTS = {"taxonomy_term": ["id", "taxonomy_id", "parent_id", "code", "label", "path", "ordinal"], "criterion": ["id", "framework_id", "parent_id", "code", "title_primary", "title_alt", "ordinal"],
           "nation": ["n_nationkey", "n_name", "n_regionkey"]}


@query(" UNION ALL ".join(_digest_sql(n, c) for n, c in _PRINTS.items()))
def table_fingerprint(spark, sf):
    out = None
    for n, cols in _PRINTS.items():
        f = audit.fingerprint(_t(spark, sf)(n).select(*cols), n)
        out = f if out is None else out.unionByName(f)
    return out


@query("""SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT id FROM citation) a
FULL OUTER JOIN (SELECT DISTINCT id FROM citation_replica) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL""")
def key_differences(spark, sf):
    t = _t(spark, sf)
    return audit.key_differences(t("citation"), t("citation_replica"), "id")


@query("""SELECT 'item without citation' AS rule, count(*)::BIGINT AS violations FROM knowledge_item k WHERE NOT EXISTS (SELECT 1 FROM citation c WHERE c.knowledge_item_id = k.id)
UNION ALL SELECT 'citation of a missing item', count(*)::BIGINT FROM citation c WHERE NOT EXISTS (SELECT 1 FROM knowledge_item k WHERE k.id = c.knowledge_item_id)
UNION ALL SELECT 'rows standing twice', count(*)::BIGINT FROM (SELECT id FROM citation GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'page out of the document', count(*)::BIGINT FROM citation c JOIN source_document d ON d.id = c.document_id WHERE c.page_index > d.page_count
UNION ALL SELECT 'placeholder status without text', count(*)::BIGINT FROM knowledge_item WHERE content_status IN ('lorem','template') AND statement IS NULL""")
def integrity_suite(spark, sf):
    t = _t(spark, sf)
    c, k, d = t("citation"), t("knowledge_item"), t("source_document")
    pages = d.select(F.col("id").alias("document_id"), "page_count")
    return audit.integrity({
        "item without citation": k.join(c.select(F.col("knowledge_item_id").alias("id")), "id", "left_anti"),
        "citation of a missing item": c.join(k.select(F.col("id").alias("knowledge_item_id")), "knowledge_item_id", "left_anti"),
        "rows standing twice": c.groupBy("id").count().filter("count > 1"),
        "page out of the document": c.join(pages, "document_id").filter("page_index > page_count"),
        "placeholder status without text": k.filter("content_status in ('lorem','template') and statement is null")})


RULES = [("tender", "ci"), ("U-value", "cs"), ("owner", "word"), ("lux", "word"), ("Clause", "cs")]


@query("""SELECT doc_id, 'tender' AS term FROM documents WHERE contains(lower(text), 'tender') UNION ALL SELECT doc_id, 'U-value' FROM documents WHERE contains(text, 'U-value')
UNION ALL SELECT doc_id, 'Clause' FROM documents WHERE contains(text, 'Clause') UNION ALL SELECT doc_id, 'owner' FROM documents WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])owner($|[^A-Za-z0-9_])')
UNION ALL SELECT doc_id, 'lux' FROM documents WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])lux($|[^A-Za-z0-9_])')""")
def forbidden_terms(spark, sf):
    return audit.forbidden_terms(_t(spark, sf)("documents"), "doc_id", "text", RULES)


@query("SELECT event_type, (value > 50) AS is_large, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS n_users, min(event_id) AS first_event FROM events GROUP BY 1, 2")
def audit_groups(spark, sf):
    return _t(spark, sf)("events").groupBy("event_type", (F.col("value") > 50).alias("is_large")).agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), F.min("event_id").alias("first_event"))


# --- jobs and streams -----------------------------------------------------------------------------------------------
@query("""WITH j AS (SELECT user_id, max(ts) AS updated_at FROM events GROUP BY 1 ORDER BY updated_at DESC, user_id LIMIT 100)
SELECT j.user_id, count(e.event_id)::BIGINT AS n_stages, string_agg(e.event_type || ':' || e.event_id, ',' ORDER BY e.event_id) AS stages FROM j JOIN events e ON e.user_id = j.user_id GROUP BY 1""")
def jobs_with_stages(spark, sf):
    """The latest jobs, bounded before the join, each with its stages nested in order."""
    e = _t(spark, sf)("events")
    jobs = e.groupBy("user_id").agg(F.max("ts").alias("updated_at")).orderBy(F.desc("updated_at"), "user_id").limit(100).select("user_id")
    nested = e.join(jobs, "user_id").groupBy("user_id").agg(F.count("*").alias("n_stages"), F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("s"))
    return nested.select("user_id", "n_stages", F.array_join(F.transform("s", lambda x: F.concat(x["event_type"], F.lit(":"), x["event_id"].cast("string"))), ",").alias("stages"))


@query("""SELECT user_id, count(*)::BIGINT AS n_events, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS failures, arg_max(event_type, (ts, event_id)) AS last_stage,
CASE WHEN count(*) FILTER (WHERE event_type = 'error') >= 3 THEN 'failed' WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'retry' ELSE 'ok' END AS state FROM events GROUP BY 1""")
def job_state_fold(spark, sf):
    return ingest.fold_jobs(_t(spark, sf)("events"), "user_id", "event_type", "ts", "event_id").select("user_id", "n_events", "failures", "last_stage", "state")


@query("SELECT DISTINCT sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")
def stream_once_by_content(spark, sf):
    """Documents read as a stream, each content once, written by idempotent batches into the shared folder."""
    schema = table(spark, sf, "documents").schema
    folder = os.path.isdir(f"{sf}/documents.parquet")
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(f"{sf}/documents.parquet") if folder else reader.option("pathGlobFilter", "documents.parquet").parquet(sf)
    unique = ingest.once_by_content(stream.filter("text is not null").select(F.sha2("text", 256).alias("sha256")))
    base = _work_folder(spark)
    ingest.run_available(unique, ingest.batch_folder_sink(f"{base}/out"), f"{base}/state")
    return spark.read.parquet(f"{base}/out").select("sha256")


def _work_folder(spark: SparkSession) -> str:
    """A fresh folder in the shared place of the cluster, on this machine only where none is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "lodestack-checkpoints")
    return f"{shared.rstrip('/')}/stream-{spark.sql('select uuid()').first()[0]}"


# --- star schema ----------------------------------------------------------------------------------------------------
@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*)::BIGINT AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, sf):
    li = _t(spark, sf)("lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT r.r_name, n.n_name, count(DISTINCT o.o_orderkey)::BIGINT AS n_orders, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY 1, 2""")
def nation_revenue(spark, sf):
    """Lines are summed per order before they meet customers, so the wide join moves orders, not lines."""
    t = _t(spark, sf)
    per_order = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    orders = t("orders").select("o_orderkey", "o_custkey").join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(
        F.countDistinct("o_orderkey").alias("n_orders"), F.round(F.sum("rev"), 2).alias("revenue"))  # 25 nations, fixed


@query("""SELECT p.p_partkey, p.p_brand, count(l.l_orderkey) FILTER (WHERE l.l_returnflag = 'N')::BIGINT AS n_inputs, count(l.l_orderkey) FILTER (WHERE l.l_linestatus = 'F')::BIGINT AS n_outputs
FROM part p LEFT JOIN lineitem l ON l.l_partkey = p.p_partkey GROUP BY 1, 2""")
def template_catalogue(spark, sf):
    """Counts by condition per catalogue entry, entries without any kept."""
    t = _t(spark, sf)
    n = t("lineitem").groupBy("l_partkey").agg(F.count(F.when(F.col("l_returnflag") == "N", 1)).alias("n_inputs"), F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("n_outputs"))
    return t("part").select("p_partkey", "p_brand").join(n, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        "p_partkey", "p_brand", F.coalesce("n_inputs", F.lit(0)).cast("long").alias("n_inputs"), F.coalesce("n_outputs", F.lit(0)).cast("long").alias("n_outputs"))


@query("SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS sheets, count(DISTINCT p_type)::BIGINT AS n FROM part GROUP BY 1")
def template_sheets(spark, sf):
    return _t(spark, sf)("part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("p_type")), ",").alias("sheets"), F.countDistinct("p_type").alias("n"))


@query("""SELECT c.c_custkey, o.o_orderkey AS first_order FROM customer c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) o
ON o.o_custkey = c.c_custkey AND o.rn = 1""")
def first_order(spark, sf):
    """A lateral top-1 as an aggregate: the least (date, key) per customer, combined map-side."""
    t = _t(spark, sf)
    first = t("orders").groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return t("customer").select("c_custkey").join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("m.o_orderkey").alias("first_order"))


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def customers_without_orders(spark, sf):
    t = _t(spark, sf)
    return t("customer").select("c_custkey").join(t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""SELECT n_name, coalesce(P, 0)::BIGINT AS p, coalesce(F, 0)::BIGINT AS f, coalesce(O, 0)::BIGINT AS o FROM (SELECT n.n_name, count(*) FILTER (WHERE o_orderstatus = 'P') AS P, count(*) FILTER (WHERE o_orderstatus = 'F') AS F,
count(*) FILTER (WHERE o_orderstatus = 'O') AS O FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1)""")
def status_pivot(spark, sf):
    t = _t(spark, sf)
    rows = t("orders").select("o_custkey", "o_orderstatus").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(
        F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    p = rows.groupBy("n_name").pivot("o_orderstatus", ["P", "F", "O"]).count()
    return p.select("n_name", *[F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x.lower()) for x in ("P", "F", "O")])


@query("""SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders QUALIFY place <= 10""")
def top_per_priority(spark, sf):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return _t(spark, sf)("orders").withColumn("place", F.row_number().over(w)).filter("place <= 10").select("o_orderkey", "o_totalprice", "place")


@query("SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour FROM events")
def event_properties(spark, sf):
    return _t(spark, sf)("events").select(
        "event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))

