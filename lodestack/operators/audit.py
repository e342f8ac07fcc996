"""Fingerprints, drift between stores, integrity rules, forbidden terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_digest(df: DataFrame):
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("∅")) for c in sorted(df.columns)]))


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """(name, n_rows, digest): independent of row order, additive, so that it is one map-side aggregate at any size.

    The digest adds up 60 bits of every row's md5; equal rows count as often as they stand.
    """
    part = F.conv(F.substring(row_digest(df), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.select(part.alias("p")).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("p"), F.lit(0).cast("decimal(38,0)")).alias("s")).select(
        F.lit(name).alias("name"), "n_rows", (F.col("s") % F.lit(10**18)).cast("long").alias("digest"))


def schema_drift(left: DataFrame, right: DataFrame) -> list[tuple[str, str | None, str | None]]:
    """(column, type left, type right) wherever they differ."""
    a, b = dict(left.dtypes), dict(right.dtypes)
    return [(c, a.get(c), b.get(c)) for c in sorted(a.keys() | b.keys()) if a.get(c) != b.get(c)]


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only; one shuffle of the keys of both."""
    both = left.select(key, F.lit(1).alias("side")).unionByName(right.select(key, F.lit(2).alias("side")))
    return both.groupBy(key).agg(F.min("side").alias("lo"), F.max("side").alias("hi")).filter("lo = hi").select(
        key, F.when(F.col("lo") == 1, "left").otherwise("right").alias("side"))


def integrity(checks: dict[str, DataFrame]) -> DataFrame:
    """(rule, violations): each rule is the rows that break it."""
    out = None
    for rule, rows in checks.items():
        n = rows.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
        out = n if out is None else out.unionByName(n)
    return out


def forbidden_terms(df: DataFrame, row_id: str, text: str, rules: list[tuple[str, str]]) -> DataFrame:
    """(row_id, term): texts that hold a term; modes: ci anywhere in any case, cs as written, word as a whole word.

    The rules are compiled into the plan (a small list by nature); without rules everything would pass, so that fails.
    """
    if not rules:
        raise ValueError("no rules given")

    def hit(term: str, mode: str):
        if mode == "cs":
            return F.contains(F.col(text), F.lit(term))
        if mode == "ci":
            return F.contains(F.lower(text), F.lit(term.lower()))
        return F.col(text).rlike(rf"(?i)(?<![A-Za-z0-9_])\Q{term}\E(?![A-Za-z0-9_])")

    found = F.array_compact(F.array(*[F.when(hit(t, m), F.lit(t)) for t, m in rules]))
    return df.select(F.col(row_id), F.explode(found).alias("term"))


def table_order(references: dict[str, set[str]]) -> list[str]:
    """Tables with those they refer to first; a cycle is an error. Names of tables only, so it runs on the driver."""
    left = {t: {r for r in refs if r != t} for t, refs in references.items()}
    out: list[str] = []
    while left:
        ready = sorted(t for t, refs in left.items() if not refs - set(out))
        if not ready:
            raise ValueError(f"tables refer to each other: {sorted(left)}")
        out += ready
        for t in ready:
            del left[t]
    return out


def manifest_drift(manifest: DataFrame, present: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state): `missing` and `unlisted` on one side only, `changed` where the digests differ, else `same`; one shuffle of both."""
    both = manifest.select(key, F.lit(1).alias("side"), digest).unionByName(present.select(key, F.lit(2).alias("side"), digest))
    g = both.groupBy(key).agg(
        F.min("side").alias("lo"), F.max("side").alias("hi"), F.min(F.when(F.col("side") == 1, F.struct(digest))).alias("a"), F.min(F.when(F.col("side") == 2, F.struct(digest))).alias("b"))
    state = F.when(F.col("hi") == 1, "missing").when(F.col("lo") == 2, "unlisted").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return g.select(key, state.alias("state"))
