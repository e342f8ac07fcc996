"""Writing without MERGE: upserts, reconciliation, revisions, duplicates and replacement as joins and rewrites."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], never_copy_of: dict[str, str] | None = None) -> DataFrame:
    """Rows of both by key; a new value replaces an old one unless it is null.

    `never_copy_of` names columns whose new value is ignored where it only repeats another column (a title that is the
    bare code). Keys match null-safely; of new rows that repeat a key the least counts.
    """
    key, never_copy_of = list(key), never_copy_of or {}
    rest = [c for c in old.columns if c not in key]
    first = new.groupBy(*key).agg(F.min(F.struct(*[c for c in rest if c in new.columns])).alias("n"))
    first = first.select(*[F.col(k).alias(f"n_{k}") for k in key], "n", F.lit(True).alias("is_new"))
    on = reduce(lambda a, b: a & b, [old[k].eqNullSafe(first[f"n_{k}"]) for k in key])
    joined = old.withColumn("is_old", F.lit(True)).join(first, on, "full_outer")

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(c)
        fresh = F.col(f"n.{c}")
        if c in never_copy_of:
            other = F.coalesce(F.col(f"n_{never_copy_of[c]}") if never_copy_of[c] in key else F.col(f"n.{never_copy_of[c]}"), F.lit(""))
            fresh = F.when(fresh != other, fresh)
        return F.coalesce(fresh, F.col(c))

    keys = [F.when(F.col("is_old"), F.col(k)).otherwise(F.col(f"n_{k}")).alias(k) for k in key]
    return joined.select(*keys, *[value(c).alias(c) for c in rest])


def insert_missing(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Old rows, and new ones whose key is not there yet; of new rows that repeat a key one."""
    return old.unionByName(new.dropDuplicates(list(key)).join(old.select(*key), list(key), "left_anti"))


def stubs(facts: DataFrame, dimension: DataFrame, fact_key: str, dim_key: str = "id") -> DataFrame:
    """Keys that facts use and the dimension lacks, to be added as stubs with a warning."""
    return facts.select(F.col(fact_key).alias(dim_key)).filter(F.col(dim_key).isNotNull()).distinct().join(dimension.select(dim_key), dim_key, "left_anti")


def reconcile(wanted: DataFrame, existing: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """(key, action, new and old value): insert, rewrite, keep or stale. Rewritten rows lose what was derived from the old text."""
    key = list(key)
    w = wanted.select(*key, F.col(value).alias("new_value"), F.lit(True).alias("w"))
    e = existing.select(*key, F.col(value).alias("old_value"), F.lit(True).alias("e"))
    j = w.join(e, key, "full_outer")
    return j.withColumn("action", F.when(F.col("e").isNull(), "insert").when(F.col("w").isNull(), "stale").when(
        F.col("new_value").eqNullSafe(F.col("old_value")), "keep").otherwise("rewrite")).drop("w", "e")


def revisions(documents: DataFrame, slug: str = "slug", when: str = "ingested_at", row_id: str = "id") -> DataFrame:
    """Chain of revisions of each slug by time of arrival: what a row supersedes and whether it is the current one."""
    w = Window.partitionBy(slug).orderBy(F.col(when).asc_nulls_first(), row_id)
    return documents.withColumns({
        "revision_no": F.row_number().over(w), "supersedes": F.lag(row_id).over(w), "current": F.lead(row_id).over(w).isNull()})


def content_duplicates(df: DataFrame, content: str, row_id: str) -> DataFrame:
    """(row_id, digest, first_id, copy_no): rows with equal content, the least id first. Null content is no duplicate."""
    d = df.filter(F.col(content).isNotNull()).select(F.col(row_id), F.sha2(F.col(content), 256).alias("digest"))
    first = d.groupBy("digest").agg(F.min(row_id).alias("first_id"), F.count("*").alias("n_copies"))
    return d.join(first, "digest")


def replace_groups(old: DataFrame, new: DataFrame, group: str, spare: Column | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Rows of the groups in `new` (or in `groups`, so that one can be emptied) are replaced by its rows, but for those that `spare` holds for."""
    gone = (groups if groups is not None else new).select(group).distinct()
    kept = old.join(gone, group, "left_anti").select(*old.columns)
    if spare is not None:
        kept = kept.unionByName(old.filter(F.coalesce(spare, F.lit(False))).join(gone, group, "left_semi").select(*old.columns))
    return kept.unionByName(new.select(*old.columns))


def without_orphans(child: DataFrame, parent: DataFrame, foreign: str, parent_key: str = "id") -> DataFrame:
    """Deleting with cascade: children whose parent is gone go too; a null reference stays."""
    keys = parent.select(F.col(parent_key).alias(foreign))
    return child.filter(F.col(foreign).isNull()).unionByName(child.join(keys, foreign, "left_semi").select(*child.columns))


def latest(events: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key in an append-only log."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order])
    return events.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def replacement_guard(old: DataFrame, new: DataFrame, group: str, protected: Column) -> DataFrame:
    """Groups whose replacement would empty them or lose protected rows: (group, n_old, n_new, n_protected, reason)."""
    o = old.groupBy(group).agg(F.count("*").alias("n_old"), F.count(F.when(protected, 1)).alias("n_protected"))
    n = new.groupBy(group).agg(F.count("*").alias("n_new"))
    j = o.join(n, group, "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)).cast("long"))
    return j.withColumn("reason", F.when(F.col("n_new") == 0, "would be empty").when(F.col("n_protected") > 0, "would lose reviewed rows")).filter("reason is not null")


def either_key(left: DataFrame, right: DataFrame, first: str, second: str, key: str) -> DataFrame:
    """Rows of `left` that either of two columns of `right` names: the disjunction as a union of keys and one semi join."""
    keys = right.select(F.col(first).alias(key)).unionByName(right.select(F.col(second).alias(key))).filter(F.col(key).isNotNull()).distinct()
    return left.join(keys, key, "left_semi")


def decide(items: DataFrame, decisions: DataFrame, at: Column, row_id: str = "id") -> DataFrame:
    """Items with review_status and reviewed_at set by `decisions` (row_id, decision); only pending items are decided on, each by its least decision."""
    d = decisions.groupBy(row_id).agg(F.min("decision").alias("_decision"))
    now = (F.col("review_status") == "pending") & F.col("_decision").isNotNull()
    return items.join(d, row_id, "left").withColumns({
        "reviewed_at": F.when(now, at).otherwise(F.col("reviewed_at")), "review_status": F.when(now, F.col("_decision")).otherwise(F.col("review_status"))}).select(items.columns)


def beyond_newest(rows: DataFrame, key: Sequence[str], order: Sequence[str], keep: int) -> DataFrame:
    """Rows of each key beyond its `keep` newest, to be pruned."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") > keep).drop("_place")


def clear_orphans(child: DataFrame, parent: DataFrame, foreign: str, parent_key: str = "id") -> DataFrame:
    """Deleting with SET NULL: references whose row is gone become null."""
    there = parent.select(F.col(parent_key).alias(foreign), F.lit(True).alias("_there")).distinct()
    linked = child.filter(F.col(foreign).isNotNull()).join(there, foreign, "left").withColumn(foreign, F.when(F.col("_there"), F.col(foreign)))
    return linked.select(child.columns).unionByName(child.filter(F.col(foreign).isNull()))
