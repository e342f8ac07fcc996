from pyspark.sql import functions as F

from lodestack.operators.hierarchy import descendant_counts, descendants, resolve_hierarchy


def brute(rows):
    parent = {}
    for i, p, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "")):
        if i is not None:
            parent.setdefault(i, p)
    out = {}
    for n in parent:
        seen, at = [n], n
        while True:
            p = parent[at]
            if p is None:
                out[n] = ("ok" , seen[::-1])
                break
            if p not in parent:
                out[n] = ("missing_parent" if at == n else "detached", seen[::-1])
                break
            if p in seen:
                out[n] = ("on_loop" if p == n else "below_loop", None)
                break
            seen.append(p)
            at = p
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id string, parent_id string, code string").withColumn("tree_id", F.lit("x"))
    return resolve_hierarchy(df, F.lit("t"), label="code", **kw)


def test_against_walk(spark):
    rows = [(str(i), str(i - 1) if i % 17 else None, f"c{i}") for i in range(1, 120)]
    rows += [("a", "b", "A"), ("b", "c", "B"), ("c", "a", "C"), ("d", "a", "D"), ("e", "d", "E"), ("s", "s", "S")]
    rows += [(f"t{i}", f"t{i-1}" if i else "e", None) for i in range(20)]
    rows += [("m", "nowhere", "M"), ("n", "m", "N"), (None, "a", "Z"), ("1", "0", "c1"), ("q", "", "Q"), ("5", "4", "c5")]
    for hot in (1_000_000, 3):
        got = {r.node_id: (r.status, r.id_path) for r in run(spark, rows, hot_rows=hot).collect()}
        assert got == brute(rows)


def test_wide_parent_is_salted(spark):
    rows = [("r", None, "r"), ("p", "r", "p")] + [(f"k{i}", "p", "k") for i in range(300)]
    got = descendant_counts(run(spark, rows, hot_rows=20)).collect()
    assert {r.node_id: r.n_descendants for r in got if r.n_descendants} == {"r": 301, "p": 300}
    assert descendants(run(spark, rows)).count() == 301 + 300


def test_empty(spark):
    assert run(spark, []).count() == 0
