from lodestack.functions import values
from lodestack.operators import extraction as X


def parse(spark, cells):
    """Parsed values of cells, or of (cell, sentence beside it)."""
    rows = [(i, *(c if isinstance(c, tuple) else (c, None))) for i, c in enumerate(cells)]
    df = values.parse_values(spark.createDataFrame(rows, "i int, cell string, beside string"), "cell", "beside")
    return [r.parsed for r in df.orderBy("i").collect()]


def test_each_form_with_and_without_unit(spark):
    """Every form of a cell, built from its parts: bounds, blanks, numbers, units."""
    cases = []
    for low in ("7", "0.25"):
        for unit, uid in (("", None), ("lux", "lux"), ("%", "pct"), ("mg/m3", "mg_m3")):
            for gap in ("", " "):
                cases += [(f"<{gap}{low}{gap}{unit}", "lte", float(low), None, uid), (f"≥{gap}{low} {unit}", "gte", float(low), None, uid)]
                cases += [(f"{low}{gap}-{gap}93{gap}{unit}", "range", float(low), 93.0, uid)]
            cases += [(f"{low} {unit}".strip(), "none", float(low), None, uid)]
    for p, (cell, comparator, low, high, uid) in zip(parse(spark, [c[0] for c in cases]), cases):
        assert p.parsed_ok and p.comparator == comparator and p.unit_id == uid, cell
        assert (p.minimum, p.maximum, p.numeric) == ((low, high, None) if high else (None, None, low)), cell
        assert p.caveat_text is None


def test_what_stands_around_a_value(spark):
    got = parse(spark, ["< 55 dBA at night", "> 12 of all rooms", "about 31 % in spring", "4-6 weeks after", "9 lux **", "-14", "-3 - -1 °C", "18 lux and 20 lux", "see 4.1.2-4.1.3", "Part K7-9", "K7.1-2", "X km of path", "tbc", " ", None])
    assert [p.parsed_ok for p in got] == [True] * 7 + [False] * 8
    assert [p.unit_symbol for p in got[:4]] == ["dBA", "of", "%", "weeks"] and got[4].caveat_text == values.CAVEAT
    assert got[5].numeric == -14 and (got[6].minimum, got[6].maximum, got[6].unit_symbol) == (-3.0, -1.0, "°C")


def test_the_sentence_beside_fills_only_gaps(spark):
    got = parse(spark, [("22", "The minimum width (m) of a path"), ("22", "A maximum share (%)"), ("< 22 lux", "The minimum width (m)"), ("none", "Width (km)"), ("5", "minimums (feet)")])
    assert [(p.comparator, p.unit_id) for p in got] == [("gte", "m"), ("lte", "pct"), ("lte", "lux"), ("none", "km"), ("none", None)]
    assert [p.parsed_ok for p in got] == [True, True, True, False, True]


def test_units_by_table_and_by_slug(spark):
    from pyspark.sql import functions as F

    rows = [*((k, *v) for k, v in values.UNIT_ALIASES.items()), ("Per Week", "perweek", "Per Week"), (" ", None, None), (None, None, None), ("·", None, "·")]
    df = spark.createDataFrame(rows, "s string, uid string, symbol string")
    assert df.select(values.unit_of(F.col("s")).alias("u"), "uid", "symbol").filter("not (u.unit_id <=> uid and u.unit_symbol <=> symbol)").count() == 0


def test_extraction(spark):
    long = "A first line\n" + "real words about a facade " * 20
    pages = spark.createDataFrame([("d", "unknown", 1, long, "real"), ("d", "unknown", 2, "WIP " + long, "real"), ("d", "odd", 3, long, None), ("d", None, 4, long, "lorem"), ("d", None, 5, "short", "real")],
                                  "document_id string, doc_kind string, page int, text string, content_status string")
    got = {r.page: r for r in X.extract(pages).collect()}
    assert set(got) == {1, 3} and got[1].title == "A first line"
    assert X.unknown_fields(["page", "x"], pages) == ["x"]
    rows, lost = X.resolve_refs(spark.createDataFrame([("a",), ("b",), (None,)], "r string"), "r", spark.createDataFrame([("a", "1")], "ref string, id string"), "rid")
    assert {(r.r, r.rid) for r in rows.collect()} == {("a", "1"), ("b", None), (None, None)} and [r.r for r in lost.collect()] == ["b"]


def test_cells_and_vectors(spark):
    cells = spark.createDataFrame([("s", "A1", "5", None), ("s", "A2", "Total", None), ("s", "B1", "10", "=A1*2"), ("s", "C1", "11", "=$B$1+1")], "sheet string, ref string, value string, formula string")
    assert {r.ref: r.role for r in X.cell_roles(cells).collect()} == {"A1": "input", "A2": "label", "B1": "calc", "C1": "output"}
    chunks = spark.createDataFrame([("1", "ab", None), ("2", "abc", [9.0]), ("3", None, None)], "id string, text string, embedding array<float>")
    got = {r.id: r.embedding for r in X.embed_missing(chunks, lambda ts: [[float(len(t))] for t in ts]).collect()}
    assert got == {"1": [2.0], "2": [9.0], "3": None}
    fresh = spark.createDataFrame([("2", "new"), ("1", "ab")], "id string, text string")
    assert {r.id: (r.text, r.embedding) for r in X.refresh_text(chunks, fresh).collect()}["2"] == ("new", None)
