"""Differences between two copies of a dataset, field by field.

Both copies are tagged, united and grouped once by key; one struct per side is collected and the
structs are compared by a generated higher-order expression. One shuffle, no join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def diff_copies(
    primary: DataFrame, replica: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row per finding: the key columns, finding, primary_value, replica_value.

    finding is `only_in_primary`, `only_in_replica` or the name of a column whose values differ
    (values as text, null where null). Any difference counts: null against empty, blanks, letter
    case. NaN equals NaN. A column that only one side has counts as null on the other; `columns`
    restricts the comparison. Rows are matched by key; null keys match each other. Of rows that
    repeat a key on one side the least row counts (nulls first), so exact repeats are no
    difference, and the partial aggregate keeps a key with very many copies to one struct per
    map task. Two empty sides give no rows. Types of a column must agree or be castable to text;
    maps are compared as sorted entries.
    """
    key = list(key)
    names = list(dict.fromkeys(c for c in [*primary.columns, *replica.columns] if c not in key))
    if columns is not None:
        names = [c for c in names if c in set(columns)]
    types: dict[str, str] = {}
    for c in names:
        a, b = dict(primary.dtypes).get(c), dict(replica.dtypes).get(c)
        types[c] = a if b is None or a == b else b if a is None else "string"

    def side(df: DataFrame, tag: int) -> DataFrame:
        def field(i: int, c: str):
            if c not in df.columns:
                return F.lit(None).cast(types[c]).alias(f"f{i}")
            col = F.col(_quoted(c)).cast(types[c])
            return (F.array_sort(F.map_entries(col)) if types[c].startswith("map<") else col).alias(f"f{i}")

        return df.select(
            *[F.col(_quoted(k)).alias(f"k{i}") for i, k in enumerate(key)], F.lit(tag).cast("byte").alias("side"),
            F.struct(F.lit(True).alias("here"), *[field(i, c) for i, c in enumerate(names)]).alias("row"))

    both = side(primary, 0).unionByName(side(replica, 1))
    grouped = both.groupBy(*[f"k{i}" for i in range(len(key))]).agg(
        F.min(F.when(F.col("side") == 0, F.col("row"))).alias("a"), F.min(F.when(F.col("side") == 1, F.col("row"))).alias("b"))
    entries = ", ".join(
        "named_struct('finding', '%s', 'same', a.f%d <=> b.f%d, 'primary_value', cast(a.f%d as string), 'replica_value', cast(b.f%d as string))"
        % (c.replace("\\", "\\\\").replace("'", "\\'"), i, i, i, i) for i, c in enumerate(names))
    lone = "array(named_struct('finding', '%s', 'same', false, 'primary_value', cast(null as string), 'replica_value', cast(null as string)))"
    changed = f"filter(array({entries}), x -> not x.same)" if names else "slice(" + lone % "" + ", 1, 0)"
    found = F.expr(f"case when b is null then {lone % 'only_in_primary'} when a is null then {lone % 'only_in_replica'} else {changed} end")
    return grouped.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(key)], F.explode(found).alias("x")).select(
        *[_quoted(k) for k in key], "x.finding", "x.primary_value", "x.replica_value")
