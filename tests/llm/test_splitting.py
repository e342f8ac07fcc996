import random

from pyspark.sql import functions as F

from lodestack.llm import splitting as S


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéß²_0") for _ in range(rng.randint(1, 11)))
    out = ["", " \n\f ", "x" * 5000, "word " * 900, "\f".join("Page. " * 90 for _ in range(6)), "!" * 900, "a\n" * 1200, "über " * 30]
    for _ in range(40):
        sep = ["\n", "\n\n", "\f", " ", ". ", "; ", "\n• ", "|", " ", " "]
        out.append("".join(word() + rng.choice(sep) for _ in range(rng.randint(1, 1500))))
    return out


def test_round_trip_and_limits():
    for limit, overlap in ((420, 200), (60, 40)):
        for x in texts():
            parts = S.split_text(x, limit, overlap)
            if not x.strip():
                assert parts == [] or S._exact(x) > limit
                continue
            assert "".join(x[n:e] for _, n, e in parts) == x
            assert all(S._exact(x[s:e]) <= limit for s, _, e in parts)
            assert len(parts) == 1 if S._exact(x) <= limit else len(parts) > 1
            for (s0, n0, e0), (s, n, e) in zip(parts, parts[1:]):
                assert n == e0 and s <= n


def _sections(n=5):
    body = "It says what is to be done here and by whom, in words of no great length. " * n
    return f"# A\n\n## A1\n\n{body}\n\n## A2\n\n{body}\n\n# B\n\n## B1\n\n{body}\n\n## B2\n\n{body}\n"


def test_headings_stay_with_what_they_head():
    for n in (2, 5, 9, 14, 40):
        x = _sections(n)
        new = [x[a:b] for _, a, b in S.split_text(x, 420, 200)]
        assert "".join(new) == x
        for p in new:
            rows = [r for r in p.split("\n") if r.strip()]
            assert not rows[-1].startswith("#") and not all(r.startswith("#") for r in rows)
        assert len(new) == 1 or any(p.startswith("# B\n\n## B1") for p in new)  # no piece joins A2 to B1


def test_tree_and_its_levels():
    x = "1 Scope\n\nText of it.\n\n1.1 Limits\n\n- one\n  - inner\n- two\n\nANNEX\n\nTitle\n-----\n\nA line\twith a tab\nb\tc\n"
    root = S.parse(x)
    first, annex = root.children
    assert x[first.a : first.b].startswith("1 Scope") and [c.kind for c in first.children] == ["heading", "block", "section"]
    items = first.children[2].children[1].children
    assert [i.kind for i in items] == ["item", "item"] and items[0].children[1].kind == "item"
    assert [c.level for c in annex.children[1:]] == [2] and [c.kind for c in annex.children[1].children[1].children] == ["line", "line"]

    def whole(node):
        at = node.a
        for c in node.children:
            assert c.a == at
            whole(c)
            at = c.b
        assert not node.children or at == node.b

    for y in [x, _sections(), *texts()]:
        whole(S.parse(y))


def test_a_dense_stretch_shortens_only_what_is_near_it():
    calm = "A plain sentence of some length stands here and goes on a little while. " * 120
    x = calm + "\n\n" + "% + = ! " * 120 + "\n\n" + calm
    alone = S.split_text(calm)
    assert [p for p in S.split_text(x) if p[2] < len(calm) - 2000] == [p for p in alone if p[2] < len(calm) - 2000]


def test_overlap_is_about_right():
    x = " ".join(f"Sentence number {i} is of a usual length and says little." for i in range(200))
    parts = S.split_text(x)
    assert all(140 <= n - s <= 260 for s, n, _ in parts[1:])
    assert all(x[n - 1].isspace() for _, n, _ in parts[1:])


def test_token_count_matches_python(spark):
    rows = [(i, x) for i, x in enumerate(texts() + ["m² CO₂e ½ á \x1c\x85 π _x __ 12,5", None])]
    got = {r.i: r.n for r in spark.createDataFrame(rows, "i int, t string").select("i", S.token_count(F.col("t")).alias("n")).collect()}
    assert all(got[i] == (None if x is None else S._exact(x)) for i, x in rows)


def test_operator(spark):
    long = "\f".join("Some words stand here. " * 60 for _ in range(3))
    rows = [("a", long, 3, 5, "x"), ("b", "short", 1, 1, "x"), ("c", None, 1, 1, "x"), ("d", long, None, None, "x"), ("a", long, 3, 5, "x"), (None, long, 3, 4, "x")]
    df = spark.createDataFrame(rows, "id string, text string, page_from int, page_to int, piece_text string")
    got = S.split_oversized(df).collect()
    assert {r.item_id for r in got} == {"a", "d", None} and all(r.token_count <= 420 for r in got)
    a = [r for r in got if r.item_id == "a"]
    assert len(a) == 2 * len([r for r in got if r.item_id == "d"]) and {r.page_from for r in a} == {3, 4, 5}
    assert all(r.page_from is None for r in got if r.item_id == "d") and max(r.page_to for r in got if r.item_id is None) == 4
    assert S.split_oversized(df.limit(0)).count() == 0
