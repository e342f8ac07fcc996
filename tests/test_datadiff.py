from lodestack.operators.datadiff import diff_copies

S = "id string, a string, finding string, x double"


def test_findings(spark):
    p = spark.createDataFrame(
        [("1", "u", "f", 1.0), ("2", None, "f", 1.0), ("3", "v", "f", float("nan")), ("4", "w", "f", 2.0), ("5", "s", "f", 2.0),
         ("5", "s", "f", 2.0), (None, "n", "f", None), ("7", "Ab ", "f", 0.0)], S)
    r = spark.createDataFrame(
        [("1", "u", "f", 1.0), ("2", "", "f", 1.0), ("3", "v", "g", float("nan")), ("6", "w", "f", 2.0), ("5", "s", "f", 2.0),
         (None, "n", "f", None), ("7", "ab", "f", None), ("7", "ab", "f", None)], S)
    got = {(x.id, x.finding) for x in diff_copies(p, r, ["id"]).collect()}
    assert got == {("2", "a"), ("3", "finding"), ("4", "only_in_primary"), ("6", "only_in_replica"), ("7", "a"), ("7", "x")}


def test_empty_and_missing_column(spark):
    e = spark.createDataFrame([], S)
    assert diff_copies(e, e, ["id"]).count() == 0
    p = spark.createDataFrame([("1", "u")], "id string, a string")
    assert [(x.finding, x.replica_value) for x in diff_copies(p, p.drop("a"), ["id"]).collect()] == [("a", None)]
    assert diff_copies(p.select("id"), p.select("id"), ["id"]).count() == 0
