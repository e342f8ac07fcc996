import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import residue as R
from lodestack.llm.queries import _texts

SF = os.environ.get("TEST_RESIDUE_DIR", "/root/testdata/sf0.1")
#: wording that no weak label knows
UNLISTED = [
    "Cookies are disabled in your web client.", "Esta página no existe.", "Wartungsarbeiten: bitte später erneut versuchen.", "Please replace this text with your own content.",
    "The |PROJECT_NAME| shall be reviewed by the site manager.", "This page is under construction.",
]
SOUND = [
    "The facilities lead shall review the daylight model before the second survey.", "An error of two per cent is acceptable (see Table 4).", "The template for the roof edge was cut from plywood on site.",
    "Each pergola is 3.2 m high and less than 40 % of the area is glazed.", "12", "A-3.1",
]


@pytest.fixture(scope="module")
def trained(spark):
    if not os.path.isdir(SF):
        pytest.skip("no data")
    return R.train(_texts(spark, SF).filter("text is not null"))


def test_segments_cover_the_text_and_marks_have_any_length():
    text = "A title\nFirst sentence. Second one! 3 more.\n\nshort. Next\fpage goes on. And is cut"
    got = R._cut(text)
    assert got[0] == ("A title", 0) and ("Second one!", 1) in got and got[-1] == ("And is cut", 2)
    assert R._cut("") == R._cut(" \n\f") == [] and R._cut("one") == [("one", 0)]
    for n in (5, 70, 5000):
        assert R._phrase("See {{ " + "x" * n + " }} here") and R._phrase("See <<" + "x" * n + ">> here") and R._phrase("A %" + "X" * n + "% here")
    assert not R._phrase("Less than <5 or 12 % of it, see [3].")


def test_least_score():
    z = np.array([3.0, 2.0, 1.0, 0.0])
    y = np.array([True, True, False, True])
    one = np.ones(4)
    assert R.least_score(z, y, one, 0.9, enough=1) == 1.5 and R.least_score(z, y, one, 0.7, enough=1) == 0.0
    assert R.least_score(z, y, one, 0.9, enough=9) == 0.0 and R.least_score(z, ~y, one, 0.99, enough=1) == 3.0


def test_fit_finds_the_optimum():
    seg = [(f"good word {i}", 1) for i in range(30)] + [(f"bad word {i}", 1) for i in range(10)]
    y = np.arange(40) >= 30
    w, b = R.fit_classifier(seg, y, np.ones(40))
    z = R._score(R._Hasher()([("good thing", 1), ("bad thing", 1)]), w, b)
    assert z[0] < 0 < z[1]


def test_unseen_hosts_and_unlisted_wording(trained):
    w, b, report = trained
    assert report["precision"] >= 0.95 and report["recall"] >= 0.9
    z = lambda xs: R._score(R._Hasher()([(x, 1) for x in xs]), w, b)
    assert (z(UNLISTED) > report["threshold"]).mean() >= 0.6 and not any(R._phrase(x) for x in UNLISTED)
    assert (z(SOUND) <= report["threshold"]).all()


def test_one_model_at_any_batch_size(spark, sf):
    rows = _texts(spark, sf).filter("text is not null")
    w0, b0, report0 = R.train(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
        w, b, report = R.train(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert report == report0 and b == b0 and np.array_equal(w, w0)


def test_operator(spark):
    """The classifier alone gives the rows; they agree with the weak labels, and odd input does no harm."""
    rows = _texts(spark, SF)
    found, _ = R.find_residue(rows)
    got = {(r.kind, r.record_id) for r in found.collect()}
    want = {(r.kind, r.record_id) for r in rows.collect() if r.text and any(R._phrase(s) for s, _ in R._cut(r.text))}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)
    odd = spark.createDataFrame(
        [("a", None, None, "k", "lorem ipsum dolor sit amet"), ("b", "h", "real", "k", None), ("c", "h", "real", "k", ""), (None, "h", "real", "k", "Real words stand here. " * 3000),
         ("d", "h", "real", "k", "Sound."), ("d", "h", "real", "k", "Sound.")], "record_id string, host string, status string, kind string, text string")
    assert R.find_residue(odd.withColumn("segment", F.lit(1)))[0].columns == ["record_id", "kind", "score", "segment"]
    assert "b" not in {r.record_id for r in R.find_residue(odd)[0].collect()} and R.find_residue(odd.limit(0))[0].count() == 0


REAL = ["The façade on the north side shall reduce heat gains by 12 % before handover.", "Clause 4.2: every ramp opens onto the courtyard and a clear route.",
        "Error messages shown on the panel shall be explained beside it.", "Room 404 opens onto the hall and is not found on the older plan.", "Values in the set {52, 95} are permitted.",
        "Modules A1–A5 [see Table 7] apply.", "« Zone tempérée » désigne la verrière.", "Targets of <30 kWh/m² and >42% are read together."]
BAD = ["Lorem ipsum dolor sit amet, consectetur elit.", "{{ project_name }}", "Provide XX % of ramps by 20XX.", "404 – page not found", "Please enable JavaScript to view this page.", "[insert site area]",
       "Dummy text. Sample copy for layout only.", "asdf qwer blah asdf", "Access denied.", "Project:", "<Insert level here>"]


def test_phrases():
    assert not [x for x in REAL if any(R._phrase(s) for s, _ in R._cut(x))]
    assert not [x for x in BAD if not any(R._phrase(s) for s, _ in R._cut(x))]
    assert not any(R._phrase(x) for x in ("404", "12 / 40", "A-12", ""))


def test_records(spark):
    rows = [(f"r{i}", f"h{i % 40}", "real", "chunk", REAL[i % len(REAL)] + f" {i}") for i in range(800)]
    rows += [(f"b{i}", f"h{i % 40}", ["lorem", "real", None][i % 3], "chunk", (REAL[0] + "\n" if i % 2 else "") + BAD[i % len(BAD)]) for i in range(220)]
    rows += [("n", "h", "real", "chunk", None), ("e", None, None, "chunk", ""), ("w", "h", "lorem", "chunk", "  \n \f")]
    df = spark.createDataFrame(rows, "record_id string, host string, status string, kind string, text string")
    out, report = R.find_residue(df)
    got = {r.record_id for r in out.collect()}
    bad = {f"b{i}" for i in range(220)}
    assert len(got & bad) >= 0.97 * len(bad) and not {g for g in got if g[0] != "b"}
    assert report["recall"] > 0.8
    assert R.find_residue(df.limit(0))[0].count() == 0


def test_every_labelled_segment_counts(spark):
    """60,000 records of one segment each: all on unseen hosts validate, and the threshold is that of all their scores."""
    mark = F.when(F.col("id") % 300 == 0, F.concat(F.lit("Error 404 at "), "id")).when(F.col("id") % 299 == 0, F.concat(F.lit("Wall {{ x }} "), "id")).otherwise(F.concat(F.lit("The wall is "), F.hash("id") % 97, F.lit(" high in w"), F.hex("id"), F.lit(".")))
    rows = spark.range(60_000).select(F.col("id").cast("string").alias("record_id"), F.concat(F.lit("h"), F.col("id") % 211).alias("host"), F.lit("real").alias("status"), F.lit("k").alias("kind"), mark.alias("text"))
    held = F.crc32(F.col("host").cast("binary")) % R.HELD_OUT == 0
    w, b, report = R.train(rows)
    assert report["validated"] == rows.filter(held).count() > 1000
    own = np.random.default_rng(3).normal(size=R.DIMS).astype(np.float32)
    seg = [(s, p) for r in rows.filter(held).select("text").collect() for s, p in R._cut(r.text)]
    y = np.array([R._phrase(s) for s, _ in seg])
    for weights, precision in ((w, 0.995), (own, 0.02), (own, 0.999)):
        z = R._score(R._Hasher()(seg), weights, b)
        got = R.held_out_score(R._blocks(rows).filter("held"), weights, b, precision)
        assert got["threshold"] == pytest.approx(R.least_score(z, y, np.ones(len(y)), precision), abs=1e-4)
        assert got["recall"] == pytest.approx((y & (z > got["threshold"])).sum() / y.sum(), abs=0.01)


def test_phrases_are_looked_for_where_they_can_stand(monkeypatch):
    """One segment of a text has a trigger: the others aren't searched, and none loses its label."""
    odd = ["foo\tbar\tabc", "test\u00a0test\u00a0test", "Project  :", "client\t: -", "\u017fession has expired", "Cl\u0131ck to add", "ONLY", "only", "Test test foo", "abc test test", "Revision :", "The only wall."]
    for x in [*odd, *REAL, *BAD]:
        assert R._phrase(x, True) or not R._PHRASES.search(x), x
    looked = []
    monkeypatch.setattr(R, "_PHRASES", type("", (), {"search": lambda self, x, own=R._PHRASES: looked.append(x) or own.search(x)})())
    text = " ".join(f"The wall of room {i} is high." for i in range(50)) + " Click here to add it. The end."
    hot = R._triggered(text)
    assert [s for s, _ in R._cut(text) if R._phrase(s, hot)] == looked == ["Click here to add it."]


def test_few_passes_to_the_optimum(monkeypatch):
    """Common and rare words: few costs are asked for, and the last is a least one."""
    rng = np.random.default_rng(5)
    words = np.minimum(rng.zipf(1.3, (4000, 12)), 3000)
    seg = [(" ".join(f"{chr(97 + w % 26)}{chr(97 + w // 26 % 26)}{chr(97 + w // 676)}" for w in row), 1) for row in words]
    y = (words % 97 == 5).any(1)
    costs = []
    slopes = R._slopes
    monkeypatch.setattr(R, "_slopes", lambda *a: costs.append(slopes(*a)[0] / R._WHOLE + R._RIDGE / 2 * float((a[-1][:-1] ** 2).sum())) or slopes(*a))
    R.fit_classifier(seg, y, np.ones(len(seg)))
    assert len(costs) <= 45 and costs[-1] < 0.0207  # unscaled slopes take 78


def test_stored_features_are_small_and_whole(spark):
    """Blocks hold two bytes a feature, and give the segments' own features and scores."""
    rows = spark.createDataFrame([(f"r{i}", f"h{i}", "real", "k", (REAL + BAD)[i % 19] + f" w{i}x") for i in range(200)], "record_id string, host string, status string, kind string, text string")
    blocks = R._blocks(rows)
    got = list(R._opened(iter([blocks.toPandas()]), 3))
    seg = {(s, p) for r in rows.collect() for s, p in R._cut(r.text)}
    f, _, _ = R._Hasher()(sorted(seg))
    assert sum(len(x) for x, *_ in got) == len(f) and np.array_equal(np.sort(np.concatenate([x for x, *_ in got])), np.sort(f))
    assert blocks.selectExpr("sum(length(lower) + length(upper)) n").first().n == 2 * len(f)
