"""Rows that fail to parse, with the reason, beside the typed valid rows.

Lines are read permissively under an explicit, typed schema, keeping the raw text
of those that the reader could not take: wrong counts and values that don't cast
end there. Those, and what the reader is known to be lenient about, are classified
again from the raw text: quoting, number of fields, casts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Field layouts by kind: separator and columns in file order. Fixed values.
LAYOUTS = {
    "fam": (" ", ["family_id", "member_id", "paternal_id", "maternal_id", "sex", "phenotype"]),
    "bim": ("\t", ["contig", "variant_id", "cm_pos", "pos", "a1", "a2"]),
}
#: Types of the columns that aren't text.
TYPES = {"sex": "tinyint", "phenotype": "tinyint", "pos": "int", "cm_pos": "double"}
#: Codes allowed in sex and phenotype. Fixed values.
CODES = ["0", "1", "2", "-9", "NA"]

_NUMBER = r"(?:[0-9]++(?:\.[0-9]*+)?+|\.[0-9]++)(?:[eE][+-]?[0-9]++)?+"


def _segments(line: Column) -> Column:
    """Pieces between double quotes; even positions (from 0) lie outside quotes."""
    return F.split(line, '"', -1)


def _quoting_ok(line: Column, sep: Column) -> Column:
    """Quotes stand only around whole fields, are doubled inside and closed.

    Seen through the pieces between quotes: their number is odd; the first ends
    at a separator or is empty, the last begins with one or is empty; any other
    outer piece is empty (a doubled quote) or a separator stands at both ends.
    """
    seg = _segments(line)
    last = F.size(seg) - 1

    def good(s: Column, i: Column) -> Column:
        starts = (i == 0) | s.startswith(sep)
        ends = (i == last) | s.endswith(sep)
        inner_or_empty = (i % 2 == 1) | (s == "")
        return inner_or_empty | (starts & ends)

    whole = F.forall(F.transform(seg, lambda s, i: good(s, i)), lambda x: x)
    return ~F.contains(line, F.lit('"')) | ((last % 2 == 0) & whole)


def _n_fields(line: Column, sep: Column) -> Column:
    outside = F.array_join(F.filter(_segments(line), lambda s, i: i % 2 == 0), "")
    return F.length(outside) - F.length(F.replace(outside, sep, F.lit(""))) + 1


def _fields(line: Column, sep: str) -> Column:
    """Field values of a line whose quoting and field count are right."""
    plain = F.split(line, sep, -1)
    # Separators inside quotes are hidden while splitting; \u0000 cannot stand in a text line.
    hidden = F.array_join(
        F.transform(_segments(line), lambda s, i: F.when(i % 2 == 1, F.replace(s, F.lit(sep), F.lit("\u0000"))).otherwise(s)), '"'
    )
    unquoted = F.transform(
        F.split(hidden, sep, -1),
        lambda s: F.when(
            s.startswith('"'),
            F.replace(F.replace(F.substring(s, F.lit(2), F.length(s) - 2), F.lit('""'), F.lit('"')), F.lit("\u0000"), F.lit(sep)),
        ).otherwise(s),
    )
    return F.when(F.contains(line, F.lit('"')), unquoted).otherwise(plain)


def _values_ok(kind: str, f: Column) -> Column:
    names = LAYOUTS[kind][1]
    at = lambda n: F.get(f, F.lit(names.index(n)))
    if kind == "fam":
        return at("sex").isin(CODES) & at("phenotype").isin(CODES)
    pos, cm = at("pos"), at("cm_pos")
    digits = F.ltrim(F.regexp_replace(pos, r"\A0+", ""))
    pos_ok = pos.rlike(r"\A[0-9]++\z") & (F.length(digits) <= 10) & (F.coalesce(F.try_to_number(F.when(F.length(digits) <= 10, F.concat(F.lit("0"), digits)), F.lit("99999999999")), F.lit(0)) <= 2147483647)
    cm_ok = cm.rlike(rf"\A{_NUMBER}\z") & (cm.try_cast("double") < float("inf"))
    return pos_ok & cm_ok


def _permissive(line: Column, kind: str) -> Column:
    """Spark's reader on one line: six typed columns and the corrupt raw text."""
    sep, names = LAYOUTS[kind]
    schema = ", ".join(f"{n} {TYPES.get(n, 'string')}" for n in names) + ", corrupt string"
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}
    return F.from_csv(line, F.lit(schema), options)


def _plain(line: Column, kind: str) -> Column:
    """Whether a line has no quotes and its typed fields are spelled as allowed: readers take ``01``, ``+1``, ``1d`` or ``NaN`` too."""
    sep, names = LAYOUTS[kind]
    spelled = {"sex": f"(?:{'|'.join(CODES[:-1])})", "phenotype": f"(?:{'|'.join(CODES[:-1])})", "pos": "[0-9]++", "cm_pos": _NUMBER}
    return line.rlike(r"\A" + sep.join(spelled.get(n, rf'[^{sep}"\r\n]*+') for n in names) + r"\z")


def classify(lines: DataFrame, line: str = "raw_line", kind: str = "file_kind", widest: int = 64) -> DataFrame:
    """Add ``fields`` (array of six strings, null for bad lines) and ``reason``.

    ``reason`` is the first that applies of ``quoting``, ``columns``, ``value``;
    null for valid lines. A line is settled if the permissive reader types it and it
    is plainly spelled; all others are classified from their raw text. Lines with
    over ``widest`` separators, on which the reader itself would fail, go straight
    there. One trailing carriage return belongs to the line end. A null or empty line
    has no fields: ``columns``. So has a line of a kind without layout. Empty fields
    of valid lines are null or empty. All columns of the input are kept but for
    ``fields`` and ``reason``, which are replaced; repeated lines are judged each on
    its own.
    """
    raw = F.coalesce(F.regexp_replace(F.col(line), r"\r\z", ""), F.lit(""))
    out = lines.drop("fields", "reason").withColumn("__line", raw)
    c = F.col("__line")
    fields = reason = F.when(F.lit(False), None)
    for name, (sep, names) in LAYOUTS.items():
        here, read = F.col(kind) == name, f"__{name}"
        few = F.length(c) - F.length(F.replace(c, F.lit(sep), F.lit(""))) <= widest
        out = out.withColumn(read, _permissive(F.when(here & few, c), name))
        settled = F.col(read).isNotNull() & F.col(f"{read}.corrupt").isNull() & _plain(c, name)
        if name == "bim":
            settled = settled & (F.col(f"{read}.cm_pos") < float("inf"))
        exact = _fields(c, sep)
        bad = (
            F.when(~_quoting_ok(c, F.lit(sep)), "quoting")
            .when(_n_fields(c, F.lit(sep)) != len(names), "columns")
            .when(~F.coalesce(_values_ok(name, exact), F.lit(False)), "value")
        )
        fields = fields.when(here, exact)
        reason = reason.when(here & ~settled, bad).when(here, None)
    out = out.withColumn("reason", reason.otherwise(F.lit("columns")))
    return out.withColumn("fields", F.when(F.col("reason").isNull(), fields)).drop("__line", *[f"__{k}" for k in LAYOUTS])


def bad_lines(lines: DataFrame, line: str = "raw_line", kind: str = "file_kind") -> DataFrame:
    """Lines with a reason."""
    return classify(lines, line, kind).where("reason is not null")


def typed_rows(lines: DataFrame, kind: str, line: str = "raw_line", kind_col: str = "file_kind") -> DataFrame:
    """Valid lines of one kind as typed columns, beside the input's other columns."""
    _, names = LAYOUTS[kind]
    good = classify(lines.where(F.col(kind_col) == kind), line, kind_col).where("reason is null")
    types = TYPES | {"cm_pos": "float"}
    keep = [c for c in lines.columns if c not in {line, *names}]
    val = lambda i, n: F.nullif(F.get("fields", F.lit(i)), F.lit("NA")) if n in ("sex", "phenotype") else F.get("fields", F.lit(i))
    return good.select(*keep, *[val(i, n).cast(types.get(n, "string")).alias(n) for i, n in enumerate(names)])
