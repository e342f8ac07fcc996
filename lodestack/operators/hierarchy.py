"""Parent-child links to full hierarchies, by pointer doubling.

Every node carries a pointer to an ancestor, the number of levels jumped and the path
segments passed. Joining the pointers with themselves doubles the jump, so a tree of depth
d is complete after about log2(d) rounds; nodes that no longer complete lead to a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.sources.tables import stored

#: a pointer shared by more unresolved nodes than this is joined in salted pieces
HOT_POINTER_ROWS = 200_000


def _lookup(left: DataFrame, right: DataFrame, keys: list[str], hot_rows: int, n_left: int | None = None) -> DataFrame:
    """left joined with right on `keys` (left outer), hot keys split into salted pieces; n_left, if known, tells whether any can be hot."""
    if n_left is not None and n_left <= hot_rows:
        return left.join(right, keys, "left")
    hot = left.groupBy(*keys).count().filter(F.col("count") > hot_rows).select(*keys, F.ceil(F.col("count") / hot_rows).cast("int").alias("pieces"))
    hot = stored(hot)
    if hot.isEmpty():
        return left.join(right, keys, "left")
    pieces = F.coalesce("pieces", F.lit(1))
    salted = left.join(hot, keys, "left").withColumn("salt", F.pmod(F.xxhash64("n"), pieces).cast("int")).drop("pieces")
    spread = right.join(hot, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("pieces")
    return salted.join(spread, [*keys, "salt"], "left").drop("salt")


def resolve_hierarchy(
    nodes: DataFrame, tree: Column, node_id: str = "id", parent_id: str = "parent_id", label: str = "id",
    hot_rows: int = HOT_POINTER_ROWS,
) -> DataFrame:
    """Every node with its root, depth, ids and labels from the root down, and a status.

    `tree` names the tree (or forest) a row belongs to; ids need only be unique in it.
    Returns tree, node_id, parent_id, root_id, depth, id_path, label_path, status:

    * `ok`: the way up ends at a row without parent; depth 0 is the root.
    * `missing_parent`: parent_id names no row. The node heads a detached piece.
    * `detached`: an ancestor is `missing_parent`; root_id is that head.
    * `on_loop`: the node is its own ancestor. `below_loop`: an ancestor is on a loop.
      Both have null root, depth and paths.

    Rows with a null id are left out (nothing can point at them). Of rows repeating an id the
    one with the least (parent, label) counts, null parent first. A null label stays a null
    segment; an empty parent_id is an id like any other. An empty table gives an empty result;
    further columns are ignored, whatever their names.

    Nodes are numbered once, and only those with children take part in the rounds: the others
    get their parent's path at the end. Hot pointers are looked for only where there are enough
    open nodes to make one.
    """
    base = (
        nodes.select(tree.cast("string").alias("tree"), F.col(node_id).cast("string").alias("id"),
                     F.col(parent_id).cast("string").alias("parent"), F.col(label).cast("string").alias("label"))
        .filter(F.col("id").isNotNull())
        .groupBy("tree", "id").agg(F.min(F.struct(F.col("parent"), F.col("label"))).alias("m"))
        .select("tree", "id", F.col("m.parent").alias("parent"), F.col("m.label").alias("label"))
    )
    base = stored(base.withColumn("n", F.monotonically_increasing_id()))
    n_all = base.count()
    ids = base.select("tree", F.col("id").alias("parent"), F.col("n").alias("up"))
    linked = _lookup(base.filter("parent is not null"), ids, ["tree", "parent"], hot_rows, n_all).withColumn("missing", F.col("up").isNull())
    tops = base.filter("parent is null").withColumns({"up": F.lit(None).cast("long"), "missing": F.lit(False)})
    # up: the parent's number
    linked = stored(linked.unionByName(tops))
    inner = linked.filter("up is not null").select(F.col("up").alias("n")).distinct().withColumn("inner", F.lit(True))
    every = stored(linked.join(inner, "n", "left").withColumn("inner", F.coalesce("inner", F.lit(False))))
    head = F.when(F.col("up").isNull(), F.col("id"))
    state = every.filter("inner").select(
        "n", F.col("up").alias("ptr"), F.array("id").alias("id_path"), F.array("label").alias("label_path"), head.alias("root_id"), F.col("missing").alias("head_missing"))
    finished, open_ = [state.filter("ptr is null")], stored(state.filter("ptr is not null"))
    n_open = open_.count()
    loops = None
    while n_open:
        reach = _union([*finished, open_]).select(
            F.col("n").alias("ptr"), F.col("ptr").alias("next"), F.col("root_id").alias("far_root"), F.col("head_missing").alias("far_missing"),
            F.col("id_path").alias("far_ids"), F.col("label_path").alias("far_labels"))
        step = stored(_lookup(open_.drop("root_id", "head_missing"), reach, ["ptr"], hot_rows, n_open).select(
            "n", F.col("next").alias("ptr"), F.concat("far_ids", "id_path").alias("id_path"), F.concat("far_labels", "label_path").alias("label_path"),
            F.col("far_root").alias("root_id"), F.col("far_missing").alias("head_missing")))
        open_ = step.filter("ptr is not null")
        n_rest = open_.count()
        if n_rest == n_open:  # depths are contiguous: a round that completes nothing leaves loops only
            loops = _on_loops(open_.select("n", "ptr"), hot_rows, n_rest)
            break
        # nodes deeper in the tree are found through the nodes just completed as well
        finished.append(step.filter("ptr is null"))
        n_open = n_rest
    done = _union(finished).drop("ptr").withColumn("looped", F.lit(False))
    if loops is not None:
        none = T.ArrayType(T.StringType())
        done = done.unionByName(loops.select(
            "n", F.lit(None).cast(none).alias("id_path"), F.lit(None).cast(none).alias("label_path"), F.lit(None).cast("string").alias("root_id"),
            F.lit(False).alias("head_missing"), F.col("on").alias("looped"), F.lit(True).alias("lost")), allowMissingColumns=True)
    else:
        done = done.withColumn("lost", F.lit(False))
    done = done.withColumn("lost", F.coalesce("lost", F.lit(False)))
    within = every.filter("inner").join(done, "n").select(
        "tree", "id", "parent", "missing", "root_id", "id_path", "label_path", "head_missing",
        F.when(F.col("looped"), "on_loop").when(F.col("lost"), "below_loop").alias("broken"))
    outer = every.filter("not inner")
    tops = outer.filter("up is null").select(
        "tree", "id", "parent", "missing", F.col("id").alias("root_id"), F.array("id").alias("id_path"), F.array("label").alias("label_path"),
        F.col("missing").alias("head_missing"), F.lit(None).cast("string").alias("broken"))
    below = _lookup(outer.filter("up is not null"), done.withColumnRenamed("n", "up"), ["up"], hot_rows, n_all).select(
        "tree", "id", "parent", "missing", "root_id", F.concat("id_path", F.array("id")).alias("id_path"), F.concat("label_path", F.array("label")).alias("label_path"),
        "head_missing", F.when(F.col("lost"), "below_loop").alias("broken"))
    return _union([within, tops, below]).select(
        "tree", F.col("id").alias("node_id"), F.col("parent").alias("parent_id"), "root_id",
        F.when(F.col("id_path").isNotNull(), F.size("id_path") - 1).alias("depth"), "id_path", "label_path",
        F.coalesce("broken", F.when(F.col("missing"), "missing_parent").when(F.col("head_missing"), "detached").otherwise("ok")).alias("status"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _on_loops(rest: DataFrame, hot_rows: int, n_rest: int) -> DataFrame:
    """(n, on) of nodes that lead to loops. The images of ever longer jumps shrink to the loops themselves."""
    jump = rest
    size = jump.select("ptr").distinct().count()
    while True:
        far = jump.select(F.col("n").alias("ptr"), F.col("ptr").alias("next"))
        jump = stored(_lookup(jump, far, ["ptr"], hot_rows, n_rest).select("n", F.col("next").alias("ptr")))
        image = jump.select("ptr").distinct()
        now = image.count()
        if now == size:
            break
        size = now
    on = image.select(F.col("ptr").alias("n"), F.lit(True).alias("on"))
    return stored(rest.select("n").join(on, "n", "left").select("n", F.coalesce("on", F.lit(False)).alias("on")))


def descendants(resolved: DataFrame) -> DataFrame:
    """(tree, ancestor_id, node_id, distance) for every node below every ancestor; narrow, no shuffle.

    Nodes of loops have no finite set of ancestors and give no rows.
    """
    return resolved.select(
        "tree", "node_id", "depth", F.posexplode(F.slice("id_path", 1, F.greatest(F.col("depth"), F.lit(0)))).alias("level", "ancestor_id"),
    ).select("tree", "ancestor_id", "node_id", (F.col("depth") - F.col("level")).alias("distance"))


def descendant_counts(resolved: DataFrame) -> DataFrame:
    """Per node its number of descendants and the depth of its deepest one; hash-aggregated map-side first."""
    below = descendants(resolved).groupBy("tree", F.col("ancestor_id").alias("node_id")).agg(
        F.count("*").alias("n_descendants"), F.max("distance").alias("height"))
    return resolved.join(below, ["tree", "node_id"], "left").withColumns(
        {"n_descendants": F.coalesce("n_descendants", F.lit(0).cast("long")), "height": F.coalesce("height", F.lit(0))})
