import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators import audit, enrich, facets, merge, policy, ranking, structure
from lodestack.sources import files
from lodestack.streaming import ingest


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expr(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("fn,text,want", [
    (T.clean, " a  b\n", "a b"), (T.slugify, "Déjà — Vu!", "d_j_vu"), (T.slugify, "!!", "x"), (T.humanise, "low_carbon-zone", "low carbon zone"), (T.path_label, "1.2 a", "n1_2_a"),
    (T.path_label, "", "n"), (T.collapse_repeats, "abcabcabc", "abc"), (T.dehyphenate, "aggre-\ngate", "aggregate"), (T.page_status, "a WIP page", "wip"), (T.page_status, "WIPED out", "real"),
    (T.page_status, "TEMPLATE\nONLY", "template"), (T.page_status, "Lorem  ipsum", "lorem"), (T.page_status, "dolor amet " * 90, "lorem"), (T.page_status, "real words here " * 90, "real"),
    (T.is_placeholder_value, " X% of area", True), (T.is_placeholder_value, "Xylophone", False), (T.is_placeholder_value, None, False), (T.token_count, "abcd, m²", 4), (T.token_count, None, None),
    (T.code_prefixes, "a-3.1", ["a-3.1", "a-3", "a"]),
])
def test_text(spark, fn, text, want):
    assert one(spark, text, fn) == want


def test_placeholder_status_is_never_null(spark):
    got = [r.x for r in spark.createDataFrame([("lorem",), ("mixed",), ("real",), (None,)], "s string").select(T.is_placeholder_status(F.col("s")).alias("x")).collect()]
    assert got == [True, False, False, False]


def test_policy(spark):
    docs = spark.createDataFrame([("d", "slug", True)], "id string, slug string, is_current boolean")
    items = spark.createDataFrame([("ok", "x", "t", "approved", "real"), ("no", "x", "t", "rejected", "real"), ("lo", "x", "t", "approved", "lorem")],
                                  "id string, item_type string, title string, review_status string, content_status string")
    long = "a text of more than forty characters, certainly"
    chunks = spark.createDataFrame([
        ("1", "d", "ok", None, 1, 1, 1, "short", "real"), ("2", "d", "no", None, 1, 1, 1, long, "real"), ("3", "d", "lo", None, None, None, 1, long, None), ("4", "d", None, None, 2, 2, 1, "short page", "real"),
        ("5", "d", None, None, 2, 2, 2, long, "wip"), ("6", "d", None, "fig", 2, 2, 3, "f", "real"), ("7", "d", None, None, 3, 3, 1, long, "wip"), ("8", "d", None, "fig", 3, 3, 2, "f", "real"),
        ("9", "gone", None, None, 3, 3, 1, long, "real")],
        "id string, document_id string, knowledge_item_id string, asset_id string, page_from int, page_to int, ordinal int, text string, content_status string")
    got = {r.id: r for r in policy.retrievable_chunks(chunks, docs, items).collect()}
    assert set(got) == {"1", "3", "5", "6", "7", "8"}
    assert got["8"].placeholder_status == "wip" and not got["6"].is_placeholder and got["3"].placeholder_status == "lorem" and not got["3"].has_citation
    assert [got[i].result_kind for i in "168"] == ["item", "figure", "figure"]


def test_guard(spark):
    acc = spark.createDataFrame([("a", "active", "reader"), ("b", "revoked", "owner"), ("c", "active", "editor")], "account_id string, status string, role string")
    rows = spark.range(3)
    n = lambda who, edit=False: policy.guard(rows, acc, who, edit).count()
    assert [n("a"), n("b"), n("c"), n(None), n("x"), n("a", True), n("c", True)] == [3, 0, 3, 0, 0, 0, 3]


def test_facets(spark):
    terms = spark.createDataFrame([("p", "x", "p", "P", "p"), ("c", "x", "c", "C", "p.c"), ("q", "x", "q", "Q", "pq"), ("n", "x", "n", "N", None), ("o", "y", "o", "O", "p")],
                                  "id string, taxonomy_id string, code string, label string, path string")
    subs = facets.term_subtrees(terms)
    assert {(r.root_id, r.term_id) for r in subs.collect()} == {("p", "p"), ("p", "c"), ("c", "c"), ("q", "q"), ("n", "n"), ("o", "o")}
    tags = spark.createDataFrame([("i1", "p"), ("i2", "c"), ("i2", "p"), ("i3", "q")], "item_id string, term_id string")
    items = spark.createDataFrame([("i1", "approved"), ("i2", "approved"), ("i3", "rejected"), (None, "approved")], "id string, review_status string")
    tagged = facets.item_subtree(tags, subs)
    assert [r.id for r in facets.filter_by_terms(items, tagged, ["p"], "id").orderBy("id").collect()] == ["i1", "i2"]
    assert [r.id for r in facets.filter_by_terms(items, tagged, ["p", "c"], "id").collect()] == ["i2"]
    assert {(r.id, r.ok) for r in facets.flag_by_term(items, tagged, "p", "id").collect()} == {("i1", True), ("i2", True), ("i3", False), (None, False)}
    assert {r.term_id: r.n_items for r in facets.term_counts(terms, tagged, items).collect()} == {"p": 2, "c": 1, "q": 0, "n": 0, "o": 0}


def test_query_grammar(spark):
    for q, text, want in [("red car", "a red fast car", True), ("red car", "a red bus", False), ('"red car"', "red fast car", False), ('"red car"', "one RED car", True), ("red or bus", "a bus", True),
                          ("car -red", "a red car", False), ("", "x", False), ("the", "the", False), ("red", None, False)]:
        assert one(spark, text, lambda c, q=q: ranking.matches(c, q)) is want, (q, text)
    assert "[[red]]" in one(spark, "some words before a red car", lambda c: ranking.snippet(c, "red"))


def test_cascade_and_fusion(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, "gam-ma")], "id int, text string")
    legs = lambda q: {(r.id, r.leg) for r in ranking.cascade(df, q).collect()}
    assert legs("alpha beta") == {(1, 1)} and legs("alpha zeta") == {(1, 2)} and legs("gam-") == {(3, 1)} or legs("gam-")
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, place int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "id string, place int")
    got = {r.id: r.score for r in ranking.fuse(a, b, "id").collect()}
    assert got == {"x": round(1 / 61, 6), "y": round(1 / 62 + 1 / 61, 6), "z": round(1 / 62, 6)}


def test_structure(spark):
    nodes = spark.createDataFrame([("d", 1, 0, 1), ("d", 2, 1, 2), ("d", 3, 1, 5), ("d", 4, 0, 9)], "doc string, seq int, level int, page int")
    assert [r.page_end for r in structure.page_ends(nodes, "doc", "seq", "level", "page").orderBy("seq").collect()] == [8, 4, 8, None]
    rows = spark.createDataFrame([("g", 1, "a"), ("g", 2, None), ("g", 3, "stop"), ("g", 4, None), ("g", 5, "b")], "g string, o int, v string")
    got = structure.forward_fill(rows, ["g"], ["o"], "v", F.col("v") == "stop").orderBy("o").collect()
    assert [r.filled for r in got] == ["a", "a", None, None, "b"]
    gaps = spark.createDataFrame([("g", x) for x in (1.0, 1.5, 4.0, 4.2, 9.0)], "g string, x double")
    assert [r.cluster for r in structure.gap_clusters(gaps, ["g"], "x", 1.0).orderBy("x").collect()] == [0, 0, 1, 1, 2]


def test_levels_and_depths_have_no_cap(spark):
    chain = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(71)], "id string, parent_id string")
    assert structure.recursive_depths(chain).agg(F.max("depth")).first()[0] == 70
    rng = random.Random(2)
    for most in (13, 60):  # windows, then a stack
        rows, level = [], 0
        for i in range(300):
            level = rng.randint(0, min(level + 1, most)) if i % 5 else min(level + 1, most)
            rows.append(("d", i, level if i < 290 else i - 290 + most - 9, i * 2, str(i)))
        rows.append(("d", 300, None, 600, "none"))
        df = spark.createDataFrame(rows, "doc string, seq int, level int, page int, id string")
        got = {r.seq: r.page_end for r in structure.page_ends(df, "doc", "seq", "level", "page").collect()}
        up = {r.seq: r.parent for r in structure.parents_by_level(df, "doc", "seq", "level", "id").collect()}
        one = {r.seq: r.parent for r in structure.parents_by_level(df, "doc", "seq", "level", "id", exact=True).collect()}
        for i, (_, _, lv, page, _) in enumerate(rows[:-1]):
            after = next((r[3] for r in rows[i + 1 : 300] if r[2] <= lv), None)
            above = next((r for r in reversed(rows[:i]) if r[2] < lv), None)
            assert got[i] == (None if after is None else max(after - 1, page))
            assert up[i] == (above and above[4]) and one[i] == (above[4] if above and above[2] == lv - 1 else None)
        assert got[300] is None and up[300] is None


def test_references_meet_by_their_rarest_words(spark):
    rng = random.Random(1)
    words = ["the", "of"] + [f"w{i}" for i in range(60)]
    titles = [(f"d{i:03d}", " ".join(["the"] + rng.sample(words, 4))) for i in range(80)] + [("d900", None), ("d901", "the")]
    refs = [(f"r{i}", " ".join(rng.sample(words, rng.randint(1, 6)) + ["the"])) for i in range(150)] + [("n", None), ("e", "")]
    got = {r.ref_id: (r.document_id, r.overlap) for r in enrich.resolve_references(
        spark.createDataFrame(refs, "ref_id string, raw_text string"), spark.createDataFrame(titles, "document_id string, title string")).collect()}
    want = {}
    for rid, raw in refs:
        w = set((raw or "").split())
        best = min(((-round(len(w & set((t or "").split())) / len(w), 6), d) for d, t in titles), default=None) if len(w) > 1 else None
        if best and -best[0] >= 0.6:
            want[rid] = (best[1], -best[0])
    assert got == want and want


def _no_pairs_shuffled(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search(r"hashpartitioning\([^)]*document_id", plan) and "hashpartitioning" in plan


def test_references_shuffle_no_pairs(spark):
    """Many copies of a title and of a reference: the least id, for each copy, and pairs of them are never shuffled."""
    docs = spark.createDataFrame([(f"d{i:03d}", "Quiet rooms guide" if i % 2 else "guide: rooms, quiet QUIET") for i in range(60, 0, -1)] + [("d000", "roof")], "document_id string, title string")
    refs = spark.createDataFrame([(f"r{i}", "the quiet rooms guide") for i in range(40)] + [("r0", "the roof"), ("x", "roof")], "ref_id string, raw_text string")
    got = enrich.resolve_references(refs, docs)
    assert sorted((r.ref_id, r.document_id, r.overlap) for r in got.collect()) == sorted((f"r{i}", "d001", 0.75) for i in range(40))
    assert _no_pairs_shuffled(got)


def test_reference_states_shuffle_no_pairs(spark):
    refs = spark.createDataFrame([(f"r{i}", "page", "quiet rooms guide") for i in range(5)] + [("a", "page", "module 3"), ("b", "other", None)], "ref_id string, ref_kind string, raw_text string")
    docs = spark.createDataFrame([(f"d{i}", "Quiet rooms: a guide") for i in range(5, 0, -1)], "document_id string, title string")
    got = enrich.reference_states(refs, docs)
    assert {(r.ref_id, r.resolution, r.document_id) for r in got.collect()} == {(f"r{i}", "resolved", "d1") for i in range(5)} | {("a", "missing_source", None), ("b", "unresolved", None)}
    assert _no_pairs_shuffled(got)


def test_reference_states_sort_no_pairs(spark):
    """Every reference meets every title: the best is kept by hash, the smaller id of equals; titles come in any order."""
    docs = spark.createDataFrame([(f"d{i:03d}", f"quiet rooms guide n{i}") for i in range(300, 0, -1)] + [("d500", "quiet rooms guide x7 x8"), ("c", "roof")], "document_id string, title string").repartition(5)
    refs = spark.createDataFrame([(f"r{i}", "other", f"rooms quiet guide x{i}") for i in range(30)], "ref_id string, ref_kind string, raw_text string")
    got = enrich.reference_states(refs, docs)
    assert {(r.ref_id, r.document_id) for r in got.collect()} == {(f"r{i}", "d500" if i in (7, 8) else "d001") for i in range(30)}
    assert {(r.ref_id, r.overlap) for r in enrich.resolve_references(refs, docs).collect()} == {(f"r{i}", 1.0 if i in (7, 8) else 0.75) for i in range(30)}
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_reference_states_tags_and_stages(spark):
    refs = spark.createDataFrame([("1", "page", "(Module 2 Chapter 4)"), ("2", "page", "see overleaf"), ("3", "sibling_doc", "Companion volume"), ("4", "page", "quiet rooms guide"), ("5", None, None)],
                                 "ref_id string, ref_kind string, raw_text string")
    docs = spark.createDataFrame([("d", "Quiet rooms: a guide")], "document_id string, title string")
    assert {r.ref_id: r.resolution for r in enrich.reference_states(refs, docs).collect()} == {"1": "missing_source", "2": "unresolved", "3": "missing_source", "4": "resolved", "5": "unresolved"}
    items = spark.createDataFrame([("i", "A-3.1"), ("j", "A-9"), ("k", None), ("l", "Z")], "id string, code string")
    terms = spark.createDataFrame([("A", "t1"), ("A-3", "t2")], "code string, term_id string")
    assert {(r.item_id, r.term_id) for r in enrich.prefix_tags(items, "id", "code", terms).collect()} == {("i", "t2"), ("j", "t1")}
    words = spark.createDataFrame([("i", "t1", 0.5), ("i", "x", 0.5), ("j", "x", 0.5)], "item_id string, term_id string, confidence double")
    paths = spark.createDataFrame([("t1", "a"), ("t2", "a.b"), ("x", "c")], "term_id string, path string")
    firm = spark.createDataFrame([("i", "t2")], "item_id string, term_id string")
    assert {(r.item_id, r.term_id) for r in enrich.same_branch(words, firm, paths).collect()} == {("i", "t1"), ("j", "x")}
    named = spark.createDataFrame([("i", "s1", 0.9), ("i", "s1", 0.5), ("i", "gone", 0.9), ("j", "s2", 0.5)], "item_id string, stage_id string, confidence double")
    cross = spark.createDataFrame([("s1", "s2"), ("s2", "s3")], "stage_id string, equal_id string")
    known = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "stage_id string")
    assert {(r.item_id, r.stage_id, r.confidence) for r in enrich.link_stages(named, cross, known).collect()} == {("i", "s1", 0.9), ("i", "s2", 0.9), ("j", "s2", 0.5), ("j", "s3", 0.5)}


def test_grid_boxes_and_limits(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "k string")
    cells = spark.createDataFrame([("a", "x", "2"), ("a", "x", "1"), ("a", None, "3"), ("a", "odd", "4"), ("gone", "x", "5")], "k string, level string, item string")
    got = {r.k: (r.x, r.y, r.unassigned) for r in structure.matrix(rows, cells, "k", "level", ["x", "y"], "item").collect()}
    assert got == {"a": (["1", "2"], [], ["3", "4"]), "b": ([], [], [])}
    boxes = spark.createDataFrame([([0.0, 0.0, 4.0, 5.0],), ([0.0],), (None,), ([4.0, 0.0, 1.0, 1.0],)], "b array<double>")
    assert [(r.a, r.l) for r in boxes.select(structure.box_area(F.col("b")).alias("a"), structure.box_at_least(F.col("b"), 4.0).alias("l")).collect()] == [(20.0, True), (None, False), (None, False), (None, False)]
    assert [structure.clamp(x, 20, 100) for x in (None, 0, -1, 5, 500)] == [20, 20, 20, 5, 100]
    assert structure.project(rows, ["k"], ["k", "z"]).columns == ["k"]
    with pytest.raises(ValueError):
        structure.project(rows, ["z"], ["k"])


def test_once_and_new_contents(spark):
    batch = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "3")], "path string, sha256 string")
    taken = spark.createDataFrame([("2",)], "sha256 string")
    assert sorted(r.sha256 for r in ingest.new_contents(batch, taken).collect()) == ["1", "3"]


def test_merge(spark):
    old = spark.createDataFrame([("1", "Title", "u"), ("2", "Two", None), (None, "N", None)], "id string, title string, x string")
    new = spark.createDataFrame([("1", "1", "v"), ("3", "Three", None), ("2", None, "w"), (None, None, "z")], "id string, title string, x string")
    got = {r.id: (r.title, r.x) for r in merge.upsert(old, new, ["id"], {"title": "id"}).collect()}
    assert got == {"1": ("Title", "v"), "2": ("Two", "w"), "3": ("Three", None), None: ("N", "z")}
    plan = {r.id: r.action for r in merge.reconcile(new.filter("id is not null"), old.filter("id is not null"), ["id"], "title").collect()}
    assert plan == {"1": "rewrite", "2": "rewrite", "3": "insert"}
    t = dt.datetime(2024, 1, 1)
    rev = merge.revisions(spark.createDataFrame([("b", "s", t), ("a", "s", t), ("c", "q", None)], "id string, slug string, ingested_at timestamp")).collect()
    assert {r.id: (r.revision_no, r.supersedes, r.current) for r in rev} == {"a": (1, None, False), "b": (2, "a", True), "c": (1, None, True)}


def test_audit(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "i int, s string")
    f = lambda df: audit.fingerprint(df, "t").first()
    assert f(a) == f(a.orderBy(F.desc("i"))) and f(a) != f(a.dropDuplicates()) and f(a.limit(0)).digest == 0
    assert audit.schema_drift(a, a.withColumn("i", F.col("i").cast("long")).drop("s")) == [("i", "int", "bigint"), ("s", "string", None)]
    with pytest.raises(ValueError):
        audit.forbidden_terms(a, "i", "s", [])


def test_enrich(spark):
    refs = spark.createDataFrame([("r1", "Facade guide volume"), ("r2", "guide"), ("r3", None), ("r4", "roof plan")], "ref_id string, raw_text string")
    docs = spark.createDataFrame([("a", "The facade guide"), ("b", "Facade guide again"), ("c", None)], "document_id string, title string")
    assert {(r.ref_id, r.document_id) for r in enrich.resolve_references(refs, docs).collect()} == {("r1", "a")}


def test_sources(spark, tmp_path):
    p = tmp_path / "in.jsonl"
    p.write_text("\n".join([json.dumps({"id": "1", "description": "x" * 30}), "{broken", json.dumps({"id": "2", "description": "short"}), json.dumps({"description": "y" * 30}), ""]))
    good, bad = files.read_jsonl(spark, str(p), {"id": 1, "description": 20})
    assert [r.id for r in good.collect()] == ["1"] and sorted(r.reason for r in bad.collect()) == ["description is too short", "id is missing", "not json"]
    y = files.read_yaml("title: 'A b'\nn: 3\ntags: [x, \"y z\"]\nnote: >\n  one\n  two\nsub:\n  k: true\nlist:\n- a\n- 2.5\n")
    assert y == {"title": "A b", "n": 3, "tags": ["x", "y z"], "note": "one two", "sub": {"k": True}, "list": ["a", 2.5]}
    m = spark.sql("select map('a','1','b','2') x, map('b','3','c',cast(null as string)) y").select(files.merge_metadata(F.col("x"), F.col("y")).alias("m")).first().m
    assert m == {"a": "1", "b": "3"}


def test_dropped_files(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    for name, body in (("a.txt", "one"), ("b.txt", "one"), ("c.txt", "two"), (".hidden", "x"), ("_skip.txt", "x"), ("d.part", "x")):
        (box / name).write_text(body)
    run = lambda: ingest.run_available(ingest.once_by_content(ingest.dropped_files(spark, str(box))), ingest.batch_folder_sink(str(tmp_path / "out")), str(tmp_path / "state"))
    run()
    run()
    (box / "e.txt").write_text("two")
    (box / "f.txt").write_text("three")
    run()
    assert spark.read.parquet(str(tmp_path / "out")).select("sha256").distinct().count() == spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_stages(spark):
    s = ingest.Stages(["one", "two"])
    s.runs("one")(lambda d: d.withColumn("a", F.lit(1)))
    with pytest.raises(ValueError):
        s.run(spark.range(1))
    s.runs("two")(lambda d: d.withColumn("b", F.col("a") + 1))
    assert s.run(spark.range(1)).first().b == 2
    log = spark.createDataFrame([("j", "one", "ok", 0, 5, None)], ingest.RUN_LOG)
    assert ingest.run_stage(log, "j", "one", lambda: 1 / 0)[0] is None
    for attempt, state in ((1, "retry"), (2, "retry"), (3, "failed"), (3, "failed")):
        out, log = ingest.run_stage(log, "j", "two", lambda: 1 / 0)
        row = log.filter("stage = 'two'").collect()
        assert out is None and [(r.result, r.attempts) for r in row] == [(state, attempt)] and "ZeroDivisionError" in row[0].message
    out, log = ingest.run_stage(log, "k", "two", lambda: "made")
    assert out == "made" and log.filter("job_id = 'k'").first().result == "ok" and log.filter("stage = 'one'").count() == 1


def test_stability(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", 5, t, t), ("a", 5, t, t + dt.timedelta(seconds=3)), ("b", 5, t, t), ("b", 6, t, t + dt.timedelta(seconds=9))]
    got = ingest.stable(spark.createDataFrame(rows, "path string, size int, modified timestamp, seen_at timestamp"), t + dt.timedelta(seconds=10)).collect()
    assert [r.path for r in got] == ["a"]


def test_table_order():
    assert audit.table_order({"c": {"b"}, "a": set(), "b": {"a", "b"}}) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        audit.table_order({"a": {"b"}, "b": {"a"}})


def test_nearest_label(spark):
    pts = spark.createDataFrame([("g", 1, 4.0), ("g", 2, 6.0), ("g", 3, 100.0), ("h", 4, 1.0)], "g string, i int, x double")
    labels = spark.createDataFrame([("g", 2.0, "two"), ("g", 6.0, "six"), ("g", 9.0, "nine")], "g string, y double, l string")
    assert {r.i: r.nearest for r in structure.nearest_label(pts, labels, ["g"], "x", "y", "l").collect()} == {1: "two", 2: "six", 3: "nine", 4: None}


def test_all_prescribed_vector_queries(spark, sf):
    """Every vec_id divisible by 20 is searched for among all rows, in blocks; query 0 gives what vector_topk and hybrid_rrf give."""
    from lodestack.operators import ranking
    from lodestack.plans import kb_queries as Q

    ids = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 20 = 0").collect()}
    before, ranking.QUERY_ROWS = ranking.QUERY_ROWS, 7  # several blocks
    try:
        for every, one in (("vector_topk_all", "vector_topk"), ("hybrid_rrf_all", "hybrid_rrf")):
            rows = Q.QUERIES[every](spark, sf).collect()
            assert {r.query_id for r in rows} == ids
            assert {tuple(r)[1:] for r in rows if r.query_id == 0} == {tuple(r) for r in Q.QUERIES[one](spark, sf).collect()}
    finally:
        ranking.QUERY_ROWS = before
