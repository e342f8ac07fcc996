"""Order within documents: page ends, forward fill, gaps, first sightings, samples, levels of trees, plain recursion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.operators.hierarchy import resolve_hierarchy


#: up to so many levels each gets a running window of its own, more are followed by a stack per group
WINDOW_LEVELS = 32


def _levels(nodes: DataFrame, level: str) -> list[int]:
    """The levels that occur, if they are few enough for windows; else none."""
    got = [r[0] for r in nodes.select(level).distinct().filter(F.col(level).isNotNull()).limit(WINDOW_LEVELS + 1).collect()]
    return sorted(got) if len(got) <= WINDOW_LEVELS else []


def page_ends(nodes: DataFrame, group: str, order: str, level: str, page: str) -> DataFrame:
    """page_end: the page before the next node at the same or a shallower level, null for the last; next_page: that node's page.

    One running window per level (levels are few) instead of a self join, from the end backwards, so that each row is added
    once. Nodes without level have no end. However many levels there are, none is left out.
    """
    levels = _levels(nodes, level)
    if not levels:
        return _ends(_by_stack(nodes, group, order, level, page, ahead=True), page)
    behind = Window.partitionBy(group).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    chosen = F.lit(None).cast("int")
    for n in levels:
        following = F.last(F.when(F.col(level) <= n, F.struct(F.col(page).alias("p"))), ignorenulls=True).over(behind)["p"]
        chosen = F.when(F.col(level) == n, following).otherwise(chosen)
    return _ends(nodes.withColumn("next_page", chosen), page)


def _ends(nodes: DataFrame, page: str) -> DataFrame:
    return nodes.withColumn("page_end", F.when(F.col("next_page").isNotNull(), F.greatest(F.col("next_page") - 1, F.col(page))))


def _by_stack(nodes: DataFrame, group: str, order: str, level: str, value: str, ahead: bool, exact: bool = False) -> DataFrame:
    """For trees of very many levels: a stack of the open nodes of each group. Adds next_page (ahead) or parent (the value of the node above)."""
    out = "next_page" if ahead else "parent"
    kind = dict(nodes.dtypes)[value] if ahead else "string"

    def run(pdf):
        pdf = pdf.sort_values(order, ascending=not ahead, kind="stable")
        stack: list[tuple[int, object]] = []
        got = []
        for lv, v in zip(pdf[level], pdf[value]):
            if lv is None or lv != lv:
                got.append(None)
                continue
            while stack and (stack[-1][0] > lv if ahead else stack[-1][0] >= lv):
                stack.pop()
            top = stack[-1] if stack else None
            got.append(top[1] if top and (not exact or top[0] == lv - 1) else None)
            stack.append((lv, v))
        pdf = pdf.assign(**{out: got})
        return pdf.astype({out: "Int64"}) if kind in ("int", "bigint") else pdf

    fields = ", ".join(f"`{c}` {t}" for c, t in nodes.dtypes)
    return nodes.groupBy(group).applyInPandas(run, f"{fields}, {out} {kind}")


def forward_fill(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, reset: Column | None = None, out: str = "filled") -> DataFrame:
    """The last value at or before a row; `reset` rows clear it."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = F.when(F.coalesce(reset, F.lit(False)), F.struct(F.lit(None).cast("string").alias("v"))) if reset is not None else None
    has = F.when(F.col(value).isNotNull(), F.struct(F.col(value).cast("string").alias("v")))
    return df.withColumn(out, F.last(F.coalesce(marked, has) if marked is not None else has, ignorenulls=True).over(w)["v"])


def gap_clusters(df: DataFrame, group: Sequence[str], order: str | Sequence[str], gap: float, out: str = "cluster") -> DataFrame:
    """Numbers the runs of rows whose successive distances stay within `gap`; distances are of the first of `order`, the rest parts ties."""
    order = [order] if isinstance(order, str) else list(order)
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("jump", F.coalesce((F.col(order[0]) - F.lag(order[0]).over(w) > gap).cast("int"), F.lit(0))).withColumn(
        out, F.sum("jump").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("jump")


def first_sightings(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key; the least by an aggregate, so that a common key isn't sorted in one task."""
    rest = [c for c in df.columns if c not in (*key, *order)]
    return df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("m")).select(*key, "m.*")


def stratified(df: DataFrame, stratum: str, order: str, n: int) -> DataFrame:
    """Round robin over the strata: the first of each, then the second of each, up to n rows."""
    w = Window.partitionBy(stratum).orderBy(order)
    return df.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= n).orderBy("turn", stratum).limit(n)


def topological(nodes: DataFrame, tree: Column, node_id: str = "id", parent_id: str = "parent_id") -> DataFrame:
    """node_id, level: parents before children; nodes on or below loops come last with null level."""
    return resolve_hierarchy(nodes, tree, node_id, parent_id).select("tree", "node_id", "status", F.col("depth").alias("level"))


def recursive_depths(nodes: DataFrame, node_id: str = "id", parent_id: str = "parent_id") -> DataFrame:
    """id, depth of every node that a walk from a root reaches, at any depth."""
    return resolve_hierarchy(nodes, F.lit("t"), node_id, parent_id).filter("status = 'ok'").select(F.col("node_id").alias("id"), "depth")


def parents_by_level(nodes: DataFrame, group: str, order: str, level: str, node_id: str, exact: bool = False) -> DataFrame:
    """parent: the last node before a row that is shallower (with `exact`, exactly one level up and not cut off by a shallower one).

    Nodes without level have none, nor are they one. However many levels there are, none is left out.
    """
    levels = _levels(nodes, level)
    if not levels:
        return _by_stack(nodes.withColumn("_as_text", F.col(node_id).cast("string")), group, order, level, "_as_text", ahead=False, exact=exact).drop("_as_text")
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    chosen = F.lit(None).cast("string")
    for n in levels:
        last = F.last(F.when(F.col(level) < n, F.struct(F.col(node_id).cast("string").alias("id"), F.col(level).alias("level"))), ignorenulls=True).over(before)
        chosen = F.when(F.col(level) == n, F.when(last["level"] == n - 1, last["id"]) if exact else last["id"]).otherwise(chosen)
    return nodes.withColumn("parent", chosen)


def weighted_mode(df: DataFrame, group: Sequence[str], value: str, weight: Column) -> DataFrame:
    """The value of most weight in each group, the least on a tie; two partial aggregates."""
    sums = df.groupBy(*group, value).agg(F.sum(weight).alias("w"))
    return sums.groupBy(*group).agg(F.min(F.struct((-F.col("w")).alias("w"), value)).alias("m")).select(*group, F.col(f"m.{value}").alias(value), (-F.col("m.w")).alias("weight"))


def nearest_label(points: DataFrame, labels: DataFrame, on: Sequence[str], at: str, label_at: str, label: str) -> DataFrame:
    """The label closest to each point among those of the same group; the lower one on a tie.

    Both sides are merged into one ordered stream and looked up behind and ahead, so that no pair of all is formed.
    """
    p = points.withColumns({"_at": F.col(at).cast("double"), "_l": F.lit(None).cast("string"), "_p": F.struct(*points.columns)}).select(*on, "_at", "_l", "_p")
    q = labels.select(*on, F.col(label_at).cast("double").alias("_at"), F.col(label).cast("string").alias("_l"))
    both = p.unionByName(q, allowMissingColumns=True)
    mark = F.when(F.col("_l").isNotNull(), F.struct(F.col("_at").alias("at"), F.col("_l").alias("l")))
    order = [F.col("_at"), F.col("_l").isNull()]
    behind = F.last(mark, ignorenulls=True).over(Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    back = [c.desc() for c in order]  # the same order from its end, so that each row is added once
    ahead = F.last(mark, ignorenulls=True).over(Window.partitionBy(*on).orderBy(*back).rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumns({"_b": behind, "_a": ahead}).filter(F.col("_p").isNotNull())
    nearer = F.col("_b.at").isNull() | (F.col("_a.at") - F.col("_at") < F.col("_at") - F.col("_b.at"))
    return out.select("_p.*", F.when(nearer & F.col("_a.at").isNotNull(), F.col("_a.l")).otherwise(F.col("_b.l")).alias("nearest"))


def unreached(nodes: DataFrame, tree: Column, node_id: str = "id", parent_id: str = "parent_id") -> DataFrame:
    """Nodes that no walk from a root reaches: on, below or behind something broken."""
    return resolve_hierarchy(nodes, tree, node_id, parent_id).filter("status <> 'ok'").select("tree", "node_id", "status")


def matrix(rows: DataFrame, cells: DataFrame, key: str, level: str, levels: Sequence[str], item: str) -> DataFrame:
    """`rows` with a column per level and `unassigned`, each an array of items in order, empty where there are none.

    Items of no level, or of one that isn't among `levels`, are unassigned; items of unknown keys are left out.
    """
    at = F.when(F.col(level).isin(list(levels)), F.col(level))
    put = lambda cond, name: F.array_sort(F.array_compact(F.collect_list(F.when(cond, F.col(item))))).alias(name)
    grid = cells.withColumn("_at", at).groupBy(key).agg(*[put(F.col("_at") == v, v) for v in levels], put(F.col("_at").isNull(), "unassigned"))
    empty = F.array().cast("array<string>")
    return rows.join(grid, key, "left").select(*rows.columns, *[F.coalesce(c, empty).alias(c) for c in (*levels, "unassigned")])


def box_area(box: Column) -> Column:
    """The area of a box [x0, y0, x1, y1]; null for any other array."""
    wide, high = F.get(box, F.lit(2)) - F.get(box, F.lit(0)), F.get(box, F.lit(3)) - F.get(box, F.lit(1))
    return F.when((F.size(box) == 4) & (wide >= 0) & (high >= 0), wide * high)


def box_at_least(box: Column, side: float) -> Column:
    """Whether a box is as wide and as high as `side`; false for none."""
    wide, high = F.get(box, F.lit(2)) - F.get(box, F.lit(0)), F.get(box, F.lit(3)) - F.get(box, F.lit(1))
    return F.coalesce((F.size(box) == 4) & (wide >= side) & (high >= side), F.lit(False))


def clamp(asked: int | None, default: int, most: int) -> int:
    """A limit a caller may ask for: the default for none or less than 1, never over `most`."""
    return min(asked, most) if asked and asked > 0 else min(default, most)


def project(df: DataFrame, names: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """The named columns, of those that are allowed; another is an error."""
    wrong = [n for n in names if n not in allowed]
    if wrong:
        raise ValueError(f"columns that may not be read: {wrong}")
    return df.select(*names)
