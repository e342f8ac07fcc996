"""Facets over trees of terms: a term stands for its whole subtree; items are filtered, never multiplied."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def term_subtrees(terms: DataFrame) -> DataFrame:
    """(root_id, term_id) for every term and each of its ancestors and itself, by its dotted path.

    The ancestors' paths are prefixes of its own, so an equi-join on exploded prefixes replaces a containment join.
    Terms without a path stand for themselves only.
    """
    keyed = terms.select("id", "taxonomy_id", "path")
    parts = F.split("path", r"\.")
    up = keyed.filter("path is not null").select(
        F.col("id").alias("term_id"), "taxonomy_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))).alias("path"))
    down = keyed.select(F.col("id").alias("root_id"), "taxonomy_id", "path")
    inside = up.join(down, ["taxonomy_id", "path"]).select("root_id", "term_id")
    return inside.unionByName(keyed.filter("path is null").select(F.col("id").alias("root_id"), F.col("id").alias("term_id"))).distinct()


def item_subtree(item_terms: DataFrame, subtrees: DataFrame) -> DataFrame:
    """(item_id, root_id) for every tag and each ancestor of its term; an item tagged twice below a term stands twice."""
    return item_terms.select("item_id", "term_id").join(subtrees, "term_id").select("item_id", "root_id")


def filter_by_terms(items: DataFrame, tagged: DataFrame, term_ids: list[str], item_id: str = "item_id") -> DataFrame:
    """Items below each of the terms: one semi join per term."""
    def step(df: DataFrame, term: str) -> DataFrame:
        hit = tagged.filter(F.col("root_id") == term).select(F.col("item_id").alias(item_id))
        return df.join(hit, item_id, "left_semi")

    return reduce(step, term_ids, items)


def flag_by_term(items: DataFrame, tagged: DataFrame, term_id: str, item_id: str = "item_id", flag: str = "ok") -> DataFrame:
    """A flag that is false, never null, where the item isn't below the term, so that what a facet hides can be counted."""
    hit = tagged.filter(F.col("root_id") == term_id).select(F.col("item_id").alias(item_id)).distinct().withColumn("hit", F.lit(True))
    return items.join(hit, item_id, "left").withColumn(flag, F.coalesce("hit", F.lit(False))).drop("hit")


def term_counts(terms: DataFrame, tagged: DataFrame, items: DataFrame) -> DataFrame:
    """Per term the number of its items that aren't rejected; terms without any stay, at 0."""
    live = items.filter("review_status <> 'rejected'").select(F.col("id").alias("item_id"))
    n = tagged.join(live, "item_id").groupBy("root_id").agg(F.countDistinct("item_id").alias("n_items"))
    return terms.join(n, terms.id == n.root_id, "left").select(terms.id.alias("term_id"), "code", "label", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"))
