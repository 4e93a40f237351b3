from datetime import datetime

from karyon.operators.references import orphan_references, orphan_report

T = [datetime(2020, m, 1) for m in range(1, 13)]
P = "tab string, id string, at timestamp, seq long, state string"
R = "tab string, ref string, rec_id long, field string, at timestamp, extra string, first_at string"


def test_reasons(spark, ws):
    parents = spark.createDataFrame(
        [("f", "A", T[0], 1, "active"), ("f", "A", T[5], 2, "withdrawn"), ("f", "B", T[5], 3, "active"), ("f", "B", T[5], 3, "active"),
         ("f", "C", T[1], 4, "withdrawn"), ("f", "C", T[1], 5, "active"), ("g", "Z", T[0], 6, "active"), ("f", None, T[0], 7, "active")], P)
    refs = spark.createDataFrame(
        [("f", "A", 1, "p", T[7], "x", "y"), ("f", "B", 2, "p", T[3], "x", "y"), ("f", "B", 3, "p", T[6], "x", "y"), ("f", "C", 4, "p", T[6], "x", "y"),
         ("f", "Z", 5, "p", T[6], "x", "y"), ("f", None, 6, "p", T[6], "x", "y"), ("f", "B", 7, "q", None, "x", "y"), ("f", "B", 2, "p", T[3], "x", "y")], R)
    out = orphan_references(refs, parents, ws)
    assert sorted((r.rec_id, r.reason) for r in out.collect()) == [(1, "deleted"), (2, "late"), (2, "late"), (5, "missing")]
    assert {(r.reason, r.month): r.n for r in orphan_report(out).collect()} == {("deleted", "2020-08"): 1, ("late", "2020-04"): 2, ("missing", "2020-07"): 1}


def test_empty(spark, ws):
    none, refs = spark.createDataFrame([], P), spark.createDataFrame([("f", "A", 1, "p", T[0], "", "")], R)
    assert [r.reason for r in orphan_references(refs, none, ws).collect()] == ["missing"]
    assert orphan_references(spark.createDataFrame([], R), none, ws).count() == 0
