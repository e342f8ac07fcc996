"""Queries of the general data problems (p1, p3, p5) over the document knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import units
from lodestack.operators import datadiff, hierarchy, unit_states
from lodestack.sources.tables import table

TREES = {"taxonomy_term": "code", "criterion": "code", "doc_node": "code"}
#: trees are kept apart by their own partition column, so equal ids in two of them never meet
DIFF_TABLES = ("source_document", "citation", "knowledge_item")


def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        table(spark, sf_dir, t).select(F.lit(t).alias("tree"), "id", "parent_id", F.col(code).alias("code"))
        for t, code in TREES.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def hierarchies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.resolve_hierarchy(_forest(spark, sf_dir), F.col("tree"), label="code")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken nodes of the three trees, and stored taxonomy paths that no longer hold."""
    nodes = hierarchies(spark, sf_dir)
    broken = nodes.filter(F.col("status").isin("on_loop", "below_loop", "missing_parent")).select(
        "tree", "node_id", F.col("status").alias("finding"))
    stored = table(spark, sf_dir, "taxonomy_term").select(F.col("id").alias("node_id"), F.col("path").alias("stored"))
    stale = (
        nodes.filter("tree = 'taxonomy_term' and status = 'ok'").join(stored.filter("stored is not null"), "node_id")
        .filter(F.col("stored") != F.array_join("label_path", ".")).select("tree", "node_id", F.lit("stale_path").alias("finding"))
    )
    return broken.unionByName(stale).distinct()


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node's path, depth, root and number of descendants."""
    return hierarchy.descendant_counts(hierarchies(spark, sf_dir)).select(
        "tree", "node_id", "parent_id", "root_id", "depth", F.array_join("id_path", "/").alias("id_path"),
        F.array_join("label_path", ".", "").alias("code_path"), "status", "n_descendants", "height")


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(hierarchies(spark, sf_dir))


def differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t in DIFF_TABLES:
        diff = datadiff.diff_copies(table(spark, sf_dir, t), table(spark, sf_dir, f"{t}_replica"), ["id"])
        d = diff.select(F.lit(t).alias("table_name"), F.col("id").alias("record_id"), "finding", "primary_value", "replica_value")
        out = d if out is None else out.unionByName(d)
    return out


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differences(spark, sf_dir).select("table_name", "record_id", "finding")


def p5_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field by field, with both values as text."""
    return differences(spark, sf_dir).filter(~F.col("finding").isin("only_in_primary", "only_in_replica"))


def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets, benchmarks and parsed values that record a quantity, with all that is said of their unit."""
    t = lambda n: table(spark, sf_dir, n)
    item = t("knowledge_item").select(F.col("id").alias("record_id"), "statement", F.col("created_at").alias("ts")).groupBy("record_id").agg(
        F.min("statement").alias("statement"), F.min("ts").alias("ts"))
    req = t("requirement").select(
        F.lit("requirement").alias("record_kind"), F.col("knowledge_item_id").alias("record_id"), "metric_id", F.col("target_text").alias("value_text"),
        F.lit(None).cast("string").alias("symbol"), F.col("target_value").alias("number"), F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("high"), F.col("unit_id").alias("recorded_unit"))
    bench = t("benchmark").select(
        F.lit("benchmark").alias("record_kind"), F.col("knowledge_item_id").alias("record_id"), "metric_id", "value_text", F.lit(None).cast("string").alias("symbol"),
        F.col("value_numeric").alias("number"), F.col("value_min").alias("low"), F.col("value_max").alias("high"), F.col("unit_id").alias("recorded_unit"))
    parsed = t("parsed_value").select(
        F.lit("parsed_value").alias("record_kind"), F.col("knowledge_item_id").alias("record_id"), "metric_id", F.lit(None).cast("string").alias("value_text"),
        F.col("unit_symbol").alias("symbol"), F.col("numeric").alias("number"), F.col("minimum").alias("low"), F.col("maximum").alias("high"),
        F.col("unit_id").alias("recorded_unit"))
    unit = t("unit").select("id", "symbol", "dimension")
    metric = t("metric").join(unit.select(F.col("id").alias("default_unit_id"), "dimension"), "default_unit_id").select(
        F.col("id").alias("metric_id"), F.col("name").alias("metric_name"), F.col("default_unit_id").alias("default_unit"), "dimension")
    spelt = {r["id"]: r["symbol"] for r in unit.collect()}  # the table of units: 49 rows, fixed
    known = spark.createDataFrame(units.spellings(spelt), "dimension string, key string, spelt_unit string")
    rows = req.unionByName(bench).unionByName(parsed).join(F.broadcast(metric), "metric_id").join(item, "record_id", "left")
    q = units.quantity(F.col("value_text"))
    rows = rows.withColumn("q", q).withColumn(
        "is_quantity", F.when(F.col("record_kind") == "parsed_value", F.coalesce("number", "low", "high").isNotNull()).otherwise(F.col("q.is_quantity"))
    ).filter("is_quantity")
    # what stands in brackets right behind the metric's name, up to the word that goes on
    behind = F.expr("substring(statement, locate(concat(lower(metric_name), ' ('), lower(statement)) + length(metric_name) + 2)")
    named = F.regexp_extract(behind, r"^(.*?)\)(?=\s|[.,;:]|$)", 1)
    has_name = F.contains(F.lower("statement"), F.concat(F.lower("metric_name"), F.lit(" (")))
    rows = rows.withColumns({
        "written_key": units.spelling_key_col(F.coalesce("symbol", "q.unit_text")),
        "named_key": F.when(has_name, units.spelling_key_col(named)),
    })
    for kind in ("written", "named"):
        spell = F.broadcast(known.select("dimension", F.col("key").alias(f"{kind}_key"), F.col("spelt_unit").alias(f"{kind}_unit")))
        rows = rows.join(spell, ["dimension", f"{kind}_key"], "left")
    grouped = units.number(F.col("q.low_text"))
    decimal = units.number(F.col("q.low_text"), F.lit(True))
    two = F.col("number").isNull() & F.col("low").isNull() & F.col("q.feet").isNull() & (grouped != decimal)
    return rows.withColumns({
        "low_1": F.coalesce("low", "number", "q.feet", grouped), "high_1": F.coalesce("high", F.when(F.col("number").isNull() & F.col("q.feet").isNull(), units.number(F.col("q.high_text")))),
        "low_2": F.when(two, decimal), "high_2": F.when(two, units.number(F.col("q.high_text"), F.lit(True))),
        "device": F.concat_ws("/", "record_kind", "metric_id"),
    }).select("record_kind", "record_id", "metric_id", "dimension", "device", "ts", "value_text", "written_unit", "named_unit", "recorded_unit", "default_unit",
              "low_1", "high_1", "low_2", "high_2")


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recorded value or range in its metric's common unit: by the unit the record names, and by the one its level speaks for."""
    return unit_states.decode_units(quantities(spark, sf_dir)).select(
        "record_kind", F.col("record_id").alias("knowledge_item_id"), "metric_id", "value_text", "unit_id", "likely_unit",
        F.col("default_unit").alias("common_unit"), F.round("low_common", 9).alias("low_common"), F.round("high_common", 9).alias("high_common"),
        F.round("likely_low", 9).alias("likely_low"), F.round("likely_high", 9).alias("likely_high"))


def p1_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the likeliest course of units of a series (record kind and metric, by time) goes from one unit to another."""
    return unit_states.decode_units(quantities(spark, sf_dir)).filter("unit_before <> likely_unit").select(
        "record_kind", F.col("record_id").alias("knowledge_item_id"), "metric_id", "ts", F.col("unit_before").alias("from_unit"), F.col("likely_unit").alias("to_unit"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_values(spark, sf_dir).filter("unit_id <> common_unit").select("record_kind", "knowledge_item_id").distinct()


QUERIES = {
    "p1_found": p1_found, "p1_values": p1_values, "p1_switches": p1_switches,
    "p3_found": p3_found, "p3_paths": p3_paths, "p3_descendants": p3_descendants,
    "p5_found": p5_found, "p5_differences": p5_differences,
}
_FOREST_SQL = """WITH RECURSIVE n AS (SELECT 'taxonomy_term' AS tree, id, parent_id, code FROM taxonomy_term UNION ALL SELECT 'criterion', id, parent_id, code FROM criterion
UNION ALL SELECT 'doc_node', id, parent_id, code FROM doc_node),
up(tree, id, anc) AS (SELECT tree, id, parent_id FROM n WHERE parent_id IS NOT NULL UNION SELECT u.tree, u.id, p.parent_id FROM up u JOIN n p ON p.tree = u.tree AND p.id = u.anc WHERE p.parent_id IS NOT NULL),
looped AS (SELECT DISTINCT tree, id FROM up WHERE anc = id), below AS (SELECT DISTINCT u.tree, u.id FROM up u JOIN looped l ON l.tree = u.tree AND l.id = u.anc ANTI JOIN looped o ON o.tree = u.tree AND o.id = u.id),
missing AS (SELECT c.tree, c.id FROM n c ANTI JOIN n p ON p.tree = c.tree AND p.id = c.parent_id WHERE c.parent_id IS NOT NULL),
down(tree, id, root_id, depth, codes, ids) AS (SELECT tree, id, id, 0, [code], [id] FROM n WHERE parent_id IS NULL OR (tree, id) IN (SELECT (tree, id) FROM missing) UNION ALL
  SELECT c.tree, c.id, d.root_id, d.depth + 1, list_append(d.codes, c.code), list_append(d.ids, c.id) FROM n c JOIN down d ON c.tree = d.tree AND c.parent_id = d.id) """


def _texts_of(column: str) -> str:
    """Both values as text; points in time without their zone."""
    one = "CAST(({0}.{1} AT TIME ZONE 'UTC') AS VARCHAR)" if column.endswith("_at") else "CAST({0}.{1} AS VARCHAR)"
    return ", " + one.format("a", column) + " AS primary_value, " + one.format("b", column) + " AS replica_value"


def _diff_sql(columns: bool, values: bool = False) -> str:
    """For each table a full join on one row per id; the columns are those of the tables' definition."""
    fields = {
        "source_document": "slug title doc_kind series_ref revision issue_date content_status sha256 size_bytes page_count is_spread_paginated supersedes_id is_current ingested_at",
        "citation": "knowledge_item_id document_id page_index printed_page_label",
        "knowledge_item": "item_type document_id node_id title statement summary content_status extraction_confidence review_status reviewed_at created_at"}
    out = []
    for t, names in fields.items():
        pair = f"(SELECT DISTINCT ON (id) * FROM {t}) a {{}} JOIN (SELECT DISTINCT ON (id) * FROM {t}_replica) b ON a.id = b.id"
        if columns:
            out += [f"SELECT '{t}' AS table_name, a.id AS record_id, '{c}' AS finding{_texts_of(c) if values else ''} FROM {pair.format('')} WHERE a.{c} IS DISTINCT FROM b.{c}" for c in names.split()]
        else:
            out.append(f"SELECT '{t}' AS table_name, coalesce(a.id, b.id) AS record_id, CASE WHEN b.id IS NULL THEN 'only_in_primary' ELSE 'only_in_replica' END AS finding "
                       f"FROM {pair.format('FULL')} WHERE a.id IS NULL OR b.id IS NULL")
    return " UNION ALL ".join(out)


ORACLES: dict[str, str] = {
    "p3_found": _FOREST_SQL + """SELECT tree, id AS node_id, 'on_loop' AS finding FROM looped UNION ALL SELECT tree, id, 'below_loop' FROM below UNION ALL SELECT tree, id, 'missing_parent' FROM missing
UNION ALL SELECT d.tree, d.id, 'stale_path' FROM down d JOIN taxonomy_term t ON d.tree = 'taxonomy_term' AND t.id = d.id ANTI JOIN missing m ON m.tree = d.tree AND m.id = d.root_id
WHERE t.path IS NOT NULL AND t.path <> array_to_string(d.codes, '.')""",
    "p3_descendants": _FOREST_SQL + "SELECT tree, ids[i] AS ancestor_id, id AS node_id, depth + 1 - i AS distance FROM (SELECT *, unnest(generate_series(1, depth)) AS i FROM down)",
    "p3_paths": _FOREST_SQL + """, below_each AS (SELECT tree, ids[i] AS id, count(*) AS n, max(depth + 1 - i) AS height FROM (SELECT *, unnest(generate_series(1, depth)) AS i FROM down) GROUP BY 1, 2)
SELECT n.tree, n.id AS node_id, n.parent_id, d.root_id, d.depth, array_to_string(d.ids, '/') AS id_path, array_to_string(list_transform(d.codes, lambda x: coalesce(x, '')), '.') AS code_path,
CASE WHEN l.id IS NOT NULL THEN 'on_loop' WHEN d.id IS NULL THEN 'below_loop' WHEN m.id = n.id THEN 'missing_parent' WHEN m.id IS NOT NULL THEN 'detached' ELSE 'ok' END AS status,
coalesce(e.n, 0) AS n_descendants, coalesce(e.height, 0) AS height FROM n LEFT JOIN down d ON d.tree = n.tree AND d.id = n.id LEFT JOIN missing m ON m.tree = d.tree AND m.id = d.root_id
LEFT JOIN looped l ON l.tree = n.tree AND l.id = n.id LEFT JOIN below_each e ON e.tree = n.tree AND e.id = n.id""",
    "p5_found": _diff_sql(True) + " UNION ALL " + _diff_sql(False),
    "p5_differences": _diff_sql(True, True),
}
