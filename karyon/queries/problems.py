"""Queries pN_ of the general problems (hierarchies, references, parsing)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karyon.functions.ids import clean_id, known_parent
from karyon.operators.hierarchy import descendants, hierarchy, paths
from karyon.operators.parsing import bad_lines, typed_rows
from karyon.operators.references import orphan_references, orphan_report
from karyon.plans.workspace import Workspace


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _latest(df: DataFrame, key: str, at: str, seq: str, *cols: str) -> DataFrame:
    """The row with the latest ``at`` of each key (the largest ``seq`` among equals)."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("id"))
        .agg(F.max(F.struct(F.col(at).alias("__at"), F.col(seq).alias("__seq"), *cols)).alias("r"))
        .select("id", *[f"r.{c}" for c in cols])
    )


def lines_of_descent(spark: SparkSession, sf: str) -> DataFrame:
    """(grp, id, parent) of the three lines; grp is ``table/line``."""
    kin = _latest(table(spark, sf, "kin_pedigree"), "id", "recorded_at", "kin_row", "father", "mother")
    hk = _latest(table(spark, sf, "hk_pedigree"), "indiv_id", "recorded_at", "hk_row", "sire_id")
    kin = kin.select("id", F.explode(F.create_map(F.lit("kin_pedigree/father"), known_parent("father"), F.lit("kin_pedigree/mother"), known_parent("mother"))).alias("grp", "parent"))
    return kin.select("grp", "id", "parent").unionByName(hk.select(F.lit("hk_pedigree/sire").alias("grp"), "id", known_parent("sire_id").alias("parent")))


def p3_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    tree = hierarchy(lines_of_descent(spark, sf), Workspace(spark, "p3"))
    tab = F.split("grp", "/")
    return tree.select(tab[0].alias("tab"), tab[1].alias("line"), "id", "parent", "root", F.col("depth").cast("int").alias("depth"), "size", "looped")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_hierarchy(spark, sf).where("parent is not null").select("tab", "line", "id", "root", "depth")


def p3_paths(spark: SparkSession, sf: str) -> DataFrame:
    ws = Workspace(spark, "p3")
    tab = F.split("grp", "/")
    return paths(ws.save(hierarchy(lines_of_descent(spark, sf), ws), "tree")).select(tab[0].alias("tab"), tab[1].alias("line"), "id", "path")


def p3_descendants(spark: SparkSession, sf: str) -> DataFrame:
    ws = Workspace(spark, "p3")
    tree, tab = ws.save(hierarchy(lines_of_descent(spark, sf), ws), "tree"), F.split("grp", "/")
    return descendants(tree, tree).select(tab[0].alias("tab"), tab[1].alias("line"), "id", "descendant")


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    fam, hk = table(spark, sf, "fam"), table(spark, sf, "hk_pedigree")
    parents = fam.select(F.lit("fam").alias("tab"), clean_id("member_id").alias("id"), F.col("received_at").alias("at"), F.col("fam_row").alias("seq"), F.col("record_state").alias("state")).unionByName(
        hk.select(F.lit("hk_pedigree").alias("tab"), F.col("indiv_id").cast("string").alias("id"), F.col("recorded_at").alias("at"), F.col("hk_row").alias("seq"), F.col("record_state").alias("state"))
    )
    both = F.explode(F.create_map(F.lit("paternal_id"), clean_id("paternal_id"), F.lit("maternal_id"), clean_id("maternal_id"))).alias("field", "ref")
    refs = (
        fam.where("record_state = 'active'").select(F.lit("fam").alias("tab"), F.col("fam_row").alias("rec_id"), F.col("received_at").alias("at"), both)
    ).unionByName(
        hk.where("record_state = 'active'").select(F.lit("hk_pedigree").alias("tab"), F.col("hk_row").alias("rec_id"), F.col("recorded_at").alias("at"), F.lit("dam_id").alias("field"), known_parent("dam_id").cast("string").alias("ref"))
    )
    return orphan_references(refs, parents, Workspace(spark, "p5"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select("tab", "rec_id", "field", "reason")


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return bad_lines(table(spark, sf, "plink_raw")).select("line_id", "reason")


def p6_fam_rows(spark: SparkSession, sf: str) -> DataFrame:
    return typed_rows(table(spark, sf, "plink_raw"), "fam").select("line_id", "family_id", "member_id", "paternal_id", "maternal_id", "sex", "phenotype")


def p6_bim_rows(spark: SparkSession, sf: str) -> DataFrame:
    return typed_rows(table(spark, sf, "plink_raw"), "bim").select("line_id", "contig", "variant_id", "cm_pos", "pos", "a1", "a2")


QUERIES = {f.__name__: f for f in (p3_found, p3_hierarchy, p3_paths, p3_descendants, p5_found, p5_report, p6_found, p6_fam_rows, p6_bim_rows)}

_LINES = """
kin as (select * from (select id, father, mother, row_number() over (partition by id order by recorded_at desc nulls last, kin_row desc) rn from kin_pedigree where id is not null) where rn = 1),
hk as (select * from (select indiv_id id, sire_id, row_number() over (partition by indiv_id order by recorded_at desc nulls last, hk_row desc) rn from hk_pedigree where indiv_id is not null) where rn = 1),
link0 as (select 'kin_pedigree' tab, 'father' line, id, case when father > 0 then father end parent from kin
  union all select 'kin_pedigree', 'mother', id, case when mother > 0 then mother end from kin
  union all select 'hk_pedigree', 'sire', id, case when sire_id > 0 then sire_id end from hk),
link as (select a.tab, a.line, a.id, b.id parent from link0 a left join link0 b on a.tab = b.tab and a.line = b.line and a.parent = b.id),
down as (select tab, line, id, parent, id root, 0 depth from link where parent is null
  union all select l.tab, l.line, l.id, l.parent, d.root, d.depth + 1 from link l join down d on l.tab = d.tab and l.line = d.line and l.parent = d.id),
rest as (select * from link l where not exists (select 1 from down d where d.tab = l.tab and d.line = l.line and d.id = l.id)),
reach as (select tab, line, id, parent pt from rest
  union select r.tab, r.line, r.id, x.parent from reach r join rest x on x.tab = r.tab and x.line = r.line and x.id = r.pt),
ring as (select tab, line, id from reach where id = pt),
low as (select r.tab, r.line, r.id, min(r.pt) root from reach r join ring g on g.tab = r.tab and g.line = r.line and g.id = r.pt group by all)
"""
_ANCESTORS = """anc as (select tab, line, id, parent anc from down where parent is not null
  union all select a.tab, a.line, a.id, l.parent from anc a join link l on l.tab = a.tab and l.line = a.line and l.id = a.anc where l.parent is not null)"""
_ORPHANS = r"""
f as (select *, nullif(upper(regexp_extract(member_id, '^[\s\pZ\x{0b}\x{85}\x{FEFF}\x{200B}]*([A-Za-z]{2}-[0-9]{8})[\s\pZ\x{0b}\x{85}\x{FEFF}\x{200B}]*$', 1)), '') m,
  nullif(upper(regexp_extract(paternal_id, '^[\s\pZ\x{0b}\x{85}\x{FEFF}\x{200B}]*([A-Za-z]{2}-[0-9]{8})[\s\pZ\x{0b}\x{85}\x{FEFF}\x{200B}]*$', 1)), '') pa,
  nullif(upper(regexp_extract(maternal_id, '^[\s\pZ\x{0b}\x{85}\x{FEFF}\x{200B}]*([A-Za-z]{2}-[0-9]{8})[\s\pZ\x{0b}\x{85}\x{FEFF}\x{200B}]*$', 1)), '') ma from fam),
parents as (select 'fam' tab, m id, received_at ts, fam_row seq, record_state state from f where m is not null
  union all select 'hk_pedigree', cast(indiv_id as varchar), recorded_at, hk_row, record_state from hk_pedigree where indiv_id is not null),
held as (select tab, id, min(ts) first_at, arg_max(state, (ts, seq)) last_state from parents group by all),
refs as (select 'fam' tab, fam_row rec_id, 'paternal_id' field, pa ref, received_at ts from f where record_state = 'active'
  union all select 'fam', fam_row, 'maternal_id', ma, received_at from f where record_state = 'active'
  union all select 'hk_pedigree', hk_row, 'dam_id', case when dam_id > 0 then cast(dam_id as varchar) end, recorded_at ts from hk_pedigree where record_state = 'active'),
judged as (select r.tab, r.rec_id, r.field, r.ts, case when h.id is null then 'missing' when h.last_state = 'withdrawn' then 'deleted' when h.first_at > r.ts then 'late' end reason
  from refs r left join held h on h.tab = r.tab and h.id = r.ref where r.ref is not null)
"""
_LINE_SQL = r"""
c as (select *, case file_kind when 'fam' then ' ' when 'bim' then chr(9) end sep,
  coalesce(case when ends_with(raw_line, chr(13)) then left(raw_line, length(raw_line) - 1) else raw_line end, '') l from plink_raw),
m as (select *, case file_kind when 'fam' then regexp_full_match(l, '(?s)([^" ]*|"([^"]|"")*")( ([^" ]*|"([^"]|"")*"))*')
    when 'bim' then regexp_full_match(l, '(?s)([^"\t]*|"([^"]|"")*")(\t([^"\t]*|"([^"]|"")*"))*') else true end q_ok,
  case file_kind when 'fam' then regexp_extract(l, '(?s)^([^" ]*|"(?:[^"]|"")*") ([^" ]*|"(?:[^"]|"")*") ([^" ]*|"(?:[^"]|"")*") ([^" ]*|"(?:[^"]|"")*") ([^" ]*|"(?:[^"]|"")*") ([^" ]*|"(?:[^"]|"")*")$', ['a','b','c','d','e','f'])
    when 'bim' then regexp_extract(l, '(?s)^([^"\t]*|"(?:[^"]|"")*")\t([^"\t]*|"(?:[^"]|"")*")\t([^"\t]*|"(?:[^"]|"")*")\t([^"\t]*|"(?:[^"]|"")*")\t([^"\t]*|"(?:[^"]|"")*")\t([^"\t]*|"(?:[^"]|"")*")$', ['a','b','c','d','e','f']) end g,
  case file_kind when 'fam' then regexp_matches(l, '(?s)^([^" ]*|"([^"]|"")*")( ([^" ]*|"([^"]|"")*")){5}$')
    when 'bim' then regexp_matches(l, '(?s)^([^"\t]*|"([^"]|"")*")(\t([^"\t]*|"([^"]|"")*")){5}$') else false end six from c),
u as (select *, case when starts_with(g.a, '"') then replace(substr(g.a, 2, length(g.a) - 2), '""', '"') else g.a end f1,
  case when starts_with(g.b, '"') then replace(substr(g.b, 2, length(g.b) - 2), '""', '"') else g.b end f2,
  case when starts_with(g.c, '"') then replace(substr(g.c, 2, length(g.c) - 2), '""', '"') else g.c end f3,
  case when starts_with(g.d, '"') then replace(substr(g.d, 2, length(g.d) - 2), '""', '"') else g.d end f4,
  case when starts_with(g.e, '"') then replace(substr(g.e, 2, length(g.e) - 2), '""', '"') else g.e end f5,
  case when starts_with(g.f, '"') then replace(substr(g.f, 2, length(g.f) - 2), '""', '"') else g.f end f6 from m),
judged as (select *, case when not q_ok then 'quoting' when not six then 'columns'
  when file_kind = 'fam' and not (f5 in ('0','1','2','-9','NA') and f6 in ('0','1','2','-9','NA')) then 'value'
  when file_kind = 'bim' and not (regexp_full_match(f4, '[0-9]+') and coalesce(try_cast(f4 as hugeint), 99999999999) <= 2147483647
    and regexp_full_match(f3, '([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') and coalesce(isfinite(try_cast(f3 as double)), false)) then 'value' end reason from u)
"""

SQL = {
    "p3_found": f"with recursive {_LINES} select tab, line, id, root, depth from down where parent is not null union all select tab, line, id, root, -1 from low",
    "p3_hierarchy": f"""with recursive {_LINES}, {_ANCESTORS}, below as (select tab, line, anc id, count(*) n from anc group by all)
select d.tab, d.line, d.id, d.parent, d.root, d.depth, coalesce(b.n, 0) + 1 as size, false as looped from down d left join below b using (tab, line, id)
union all select l.tab, l.line, l.id, r.parent, l.root, -1, null, true from low l join rest r using (tab, line, id)""",
    "p3_paths": f"""with recursive {_LINES}, steps as (select tab, line, id, cast(id as varchar) path from link where parent is null
  union all select l.tab, l.line, l.id, s.path || '/' || l.id from link l join steps s on l.tab = s.tab and l.line = s.line and l.parent = s.id)
select tab, line, id, path from steps union all select tab, line, id, null from low""",
    "p3_descendants": f"with recursive {_LINES}, {_ANCESTORS} select tab, line, anc as id, id as descendant from anc",
    "p5_found": f"with {_ORPHANS} select tab, rec_id, field, reason from judged where reason is not null",
    "p5_report": f"with {_ORPHANS} select tab, field, reason, strftime(ts, '%Y-%m') as month, count(*) as n from judged where reason is not null group by all",
    "p6_found": f"with {_LINE_SQL} select line_id, reason from judged where reason is not null",
    "p6_fam_rows": f"with {_LINE_SQL} select line_id, nullif(f1,'') as family_id, nullif(f2,'') as member_id, nullif(f3,'') as paternal_id, nullif(f4,'') as maternal_id, cast(nullif(f5,'NA') as tinyint) as sex, cast(nullif(f6,'NA') as tinyint) as phenotype from judged where reason is null and file_kind = 'fam'",
    "p6_bim_rows": f"with {_LINE_SQL} select line_id, nullif(f1,'') as contig, nullif(f2,'') as variant_id, cast(f3 as float) as cm_pos, cast(f4 as int) as pos, nullif(f5,'') as a1, nullif(f6,'') as a2 from judged where reason is null and file_kind = 'bim'",
}
