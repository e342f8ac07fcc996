import pytest

import __spark_entry__ as entry
from lodestack.plans import catalogue

CORE = [n for n in catalogue.queries() if n not in ("p3_descendants",)]


def test_contract(spark):
    assert entry.entry(spark).columns == ["id", "document_slug", "result_kind", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CORE)
def test_against_sql(spark, sf, name):
    """Every core query runs; those with SQL give the same rows in another engine."""
    import glob
    import os

    duckdb = pytest.importorskip("duckdb")
    df = catalogue.queries()[name](spark, sf)
    key = lambda v: "" if v is None else f"{v:.8g}" if isinstance(v, float) else str(v)
    got = sorted([tuple(key(r[c]) for c in sorted(df.columns)) for r in df.collect()])
    sql = catalogue.oracles().get(name)
    if not sql:
        return
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    assert got == sorted([tuple(key(row[i]) for i in at) for row in r.fetchall()])


def test_units_follow_the_records(spark, sf):
    """The decoded units against the rule stated for them, read row by row."""
    import re

    from lodestack.functions.units import spelling_key, spellings
    from lodestack.plans.general_queries import p1_found

    t = lambda n: [r.asDict() for r in spark.read.parquet(f"{sf}/{n}.parquet").collect()]
    unit = {u["id"]: u for u in t("unit")}
    metric = {m["id"]: m for m in t("metric")}
    spelt = {(d, k): u for d, k, u in spellings({i: u["symbol"] for i, u in unit.items()})}
    said = {k["id"]: k["statement"] or "" for k in t("knowledge_item")}
    num = r"\d{1,3}(?:[  ,]\d{3})+(?!\d)(?:[.,]\d+)?|\d+(?:[.,]\d+)?"
    head = re.compile(rf"^\s*(?:(?:not exceeding|at least|max\.?|min\.?|approx\.?|[<>≤≥])\s*)?(?:{num})(?:\s*(?:-|–|to)\s*(?:{num}))?\s*(.*)$", re.I)
    tail = re.compile(r"(\s*\*|\s*\(mean\)|\s+for \w+|\s+during \w+|\s+by 20\d\d|\s*\b20\d\d)+\s*$")
    want = set()
    rows = [("requirement", r, r["target_text"]) for r in t("requirement")] + [("benchmark", r, r["value_text"]) for r in t("benchmark")] + [("parsed_value", r, None) for r in t("parsed_value")]
    for kind, r, text in rows:
        m = metric[r["metric_id"]]
        dim, default = unit[m["default_unit_id"]]["dimension"], m["default_unit_id"]
        if kind == "parsed_value":
            if r["numeric"] is None and r["minimum"] is None and r["maximum"] is None:
                continue
            written = spelt.get((dim, spelling_key(r["unit_symbol"] or "")))
        else:
            g = head.match(text or "")
            if not g:
                continue
            feet = re.match(r"^\D*\d+\s*(?:'|ft)\s*-?\s*\d+\s*(?:\"|in)", text)
            written = "ft" if feet else spelt.get((dim, spelling_key(tail.sub("", " " + g.group(1)))))
        s, name = said.get(r["knowledge_item_id"], "").lower(), m["name"].lower()
        g = re.search(re.escape(name) + r" \((.*?)\)(?=\s|[.,;:]|$)", s)
        named = spelt.get((dim, spelling_key(g.group(1)))) if g else None
        if (written or named or r["unit_id"] or default) != default:
            want.add((kind, r["knowledge_item_id"]))
    assert {(r.record_kind, r.knowledge_item_id) for r in p1_found(spark, sf).collect()} == want
