import pytest

from karyon.operators.parsing import bad_lines, classify, typed_rows

CASES = [
    ("fam", "F M P Q 1 2", None), ("fam", "F M P Q 1 2\r", None), ("fam", '"F" "M x" P Q "1" NA', None), ("fam", "F M P Q 1", "columns"),
    ("fam", "F M  P Q 1 2", "columns"), ("fam", "F M P Q 1 3", "value"), ("fam", "F M P Q 1 −9", "value"), ("fam", "F M P Q 1 -9", None),
    ("fam", 'F M"x P Q 1 2', "quoting"), ("fam", 'F "M P Q 1 2', "quoting"), ("fam", 'F "M"x P Q 1 2', "quoting"), ("fam", 'F """M" P Q 1 2', None),
    ("fam", 'F "a""b" P Q 1 2', None), ("fam", 'F a""b P Q 1 2', "quoting"), ("fam", "", "columns"), ("fam", None, "columns"), ("fam", '""', "columns"),
    ("bim", "1\tv\t0.5\t10\tA\tT", None), ("bim", "1\tv\t.5e-3\t10\tA\tT", None), ("bim", "1\tv\t1e999\t10\tA\tT", "value"), ("bim", "1\tv\t-1\t10\tA\tT", "value"),
    ("bim", "1\tv\tnan\t10\tA\tT", "value"), ("bim", "1\tv\t0\t2147483647\tA\tT", None), ("bim", "1\tv\t0\t2147483648\tA\tT", "value"), ("bim", "1\tv\t0\t000000000000012\tA\tT", None),
    ("bim", "1\tv\t0\t99999999999999999999999\tA\tT", "value"), ("bim", '1\t"a\tb"\t0\t"7"\tA\tT', None), ("bim", "1 v 0 1 A T", "columns"), ("bim", "\t\t0\t1\t\t", None),
    ("vcf", "x", "columns"), ("fam", 'F "' + "a" * 100_000 + '" P Q 1 2', None), ("fam", " ".join(["x"] * 30_000), "columns"), ("fam", 'F "' + '""' * 20_000 + '" P Q 1 2', None),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, k, t, "kept") for i, (k, t, _) in enumerate(CASES)], "line_id int, file_kind string, raw_line string, sex string")
    got = {r.line_id: r.reason for r in classify(df).collect()}
    assert {i: got[i] for i in got if got[i] != CASES[i][2]} == {}
    assert bad_lines(df).count() == sum(r is not None for *_, r in CASES)
    fam = {r.line_id: r for r in typed_rows(df, "fam").collect()}
    assert fam[2].member_id == "M x" and fam[2].sex == 1 and fam[2].phenotype is None
    assert fam[11].member_id == '"M' and fam[12].member_id == 'a"b'
    bim = {r.line_id: r for r in typed_rows(df, "bim").collect()}
    assert bim[26].variant_id == "a\tb" and bim[26].pos == 7 and bim[24].pos == 12


@pytest.mark.parametrize("kind", ["fam", "bim"])
def test_empty(spark, kind):
    assert typed_rows(spark.createDataFrame([], "line_id int, file_kind string, raw_line string"), kind).count() == 0
