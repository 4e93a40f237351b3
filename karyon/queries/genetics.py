"""Queries of the genetic operators over tables derived from the order data.

Variants are parts (contig: type, position: key + 1), samples are suppliers,
calls are the lines of a part and supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karyon.functions import calls as C
from karyon.operators import aggregation as agg
from karyon.operators import association as assoc
from karyon.operators import ld, popgen
from karyon.operators import pedigree as ped
from karyon.operators import relatedness as rel
from karyon.operators import windows as win
from karyon.operators.hwe import hardy_weinberg_test
from karyon.plans.workspace import Workspace

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _rounded(f, names: tuple[str, ...]):
    """Six decimals, as sums in another order differ in the last bits; the shift
    keeps exact halves from falling on either side."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return f(spark, sf).withColumns({n: F.round(F.col(n) + 1e-8, 6) + 0.0 for n in names})

    return run


def query(sql: str | None = None, doubles: str = ""):
    """Register a query by its function's name. ``doubles``: columns to round."""
    names = tuple(doubles.split())

    def add(f):
        QUERIES[f.__name__] = _rounded(f, names) if names else f
        if sql:
            text = f"with recursive {BASE}{sql}"
            if names:
                text = "select * replace (" + ", ".join(f"round({n} + 1e-8, 6) + 0.0 as {n}" for n in names) + f") from ({text})"
            SQL[f.__name__] = text
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def variants(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("contig"), (F.col("p_partkey") + 1).alias("position"))
    return win.genomic_index(p, "contig", "position", bin_size=1 << 14)


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("sample_index"), (F.col("s_nationkey") % 4 - 1).alias("sample_cohort"), F.col("s_acctbal").alias("trait"))


def calls(spark: SparkSession, sf: str, together: bool = False) -> DataFrame:
    """variant_key (the part), sample_index, call_genotype: full, partial and missing calls.

    ``together``: all of a variant lie in one partition, by the only shuffle.
    """
    o = F.sum("l_orderkey").cast("bigint")
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    g = (lines.repartition("l_partkey") if together else lines).groupBy("l_partkey", "l_suppkey").agg(
        o.alias("o"), (F.sum("l_linenumber").cast("bigint") % 2).alias("x"), (F.sum("l_quantity").cast("bigint") % 2).alias("y")
    )
    none, half = F.col("o") % 17 == 0, F.col("o") % 13 == 0
    gt = F.array(F.when(none | half, F.lit(-1)).otherwise(F.col("x")).cast("int"), F.when(none, F.lit(-1)).otherwise(F.col("y")).cast("int"))
    return g.select(F.col("l_partkey").alias("variant_key"), F.col("l_suppkey").cast("int").alias("sample_index"), gt.alias("call_genotype"))


def keyed(spark: SparkSession, sf: str, together: bool = False) -> DataFrame:
    """Calls by part key as variant_index, which saves a join where order doesn't matter."""
    return calls(spark, sf, together).withColumnRenamed("variant_key", "variant_index")


def indexed(spark: SparkSession, sf: str, together: bool = False) -> DataFrame:
    v = variants(spark, sf).select(F.col("p_partkey").alias("variant_key"), "variant_index")
    return calls(spark, sf, together).join(v, "variant_key").drop("variant_key")


def n_samples(spark: SparkSession, sf: str) -> int:
    return table(spark, sf, "supplier").count()


BASE = """v as (select p_partkey, p_type contig, p_partkey + 1 as position, row_number() over (order by p_type, p_partkey) - 1 vi from part),
s as (select s_suppkey si, s_nationkey % 4 - 1 cohort, s_acctbal trait from supplier),
g as (select l_partkey pk, l_suppkey si, cast(sum(l_orderkey) as bigint) o, cast(sum(l_linenumber) as bigint) % 2 x, cast(sum(l_quantity) as bigint) % 2 y from lineitem group by all),
c as (select pk, si, case when o % 17 = 0 or o % 13 = 0 then -1 else x end a0, case when o % 17 = 0 then -1 else y end a1 from g),
k as (select *, (a0 = 0)::int + (a1 = 0)::int n0, (a0 = 1)::int + (a1 = 1)::int n1, a0 >= 0 and a1 >= 0 called from c),
cc as (select k.pk, s.cohort, sum(n0)::bigint r, sum(n1)::bigint a from k join s using (si) where s.cohort >= 0 group by all),
"""



def _pair(col: str, prefix: str) -> list:
    return [F.get(col, F.lit(i)).alias(f"{prefix}{i}") for i in (0, 1)]


@query("""z as (select 1) select pk as variant_index, count_if(called)::bigint as n_called, count_if(called) / (select count(*) from supplier)::double as call_rate,
 count_if(called and a0 <> a1)::bigint as n_het, count_if(a0 = 0 and a1 = 0)::bigint as n_hom_ref, count_if(a0 = 1 and a1 = 1)::bigint as n_hom_alt, (count_if(called) - count_if(a0 = 0 and a1 = 0))::bigint as n_non_ref,
 sum(n0)::bigint as ac0, sum(n1)::bigint as ac1, sum(n0 + n1)::bigint as variant_allele_total, sum(n0) / nullif(sum(n0 + n1), 0)::double as af0, sum(n1) / nullif(sum(n0 + n1), 0)::double as af1 from k group by pk""", doubles="call_rate af0 af1")
def variant_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = agg.variant_stats(keyed(spark, sf), n_samples(spark, sf), 2, ploidy=2)
    return out.select("variant_index", "n_called", "call_rate", "n_het", "n_hom_ref", "n_hom_alt", "n_non_ref", *_pair("variant_allele_count", "ac"), "variant_allele_total", *_pair("variant_allele_frequency", "af"))


@query("""z as (select 1) select si::int as sample_index, count_if(called)::bigint as n_called, count_if(called) / (select count(*) from part)::double as call_rate,
 count_if(called and a0 <> a1)::bigint as n_het, count_if(a0 = 0 and a1 = 0)::bigint as n_hom_ref, count_if(a0 = 1 and a1 = 1)::bigint as n_hom_alt, (count_if(called) - count_if(a0 = 0 and a1 = 0))::bigint as n_non_ref from k group by si""", doubles="call_rate")
def sample_stats(spark: SparkSession, sf: str) -> DataFrame:
    return agg.sample_stats(keyed(spark, sf), table(spark, sf, "part").count(), ploidy=2)


@query("""z as (select 1) select pk as variant_index, si::int as sample_index, n0::bigint as ac0, n1::bigint as ac1, n0 / nullif(n0 + n1, 0)::double as af0, n1 / nullif(n0 + n1, 0)::double as af1,
 case when n0 + n1 = 2 then 2 * (1 - (n0 * n0 + n1 * n1) / 4.0::double) end as het, case when called then a0 + a1 else -1 end as genotype_index,
 case when called then a0 else -1 end as complete0, case when called then n1 else -1 end as alternates,
 (case a0 when -1 then '.' else a0::varchar end) || '/' || (case a1 when -1 then '.' else a1::varchar end) as shown from k""", doubles="af0 af1 het")
def call_functions(spark: SparkSession, sf: str) -> DataFrame:
    c = agg.count_call_alleles(keyed(spark, sf), 2, ploidy=2).withColumn("f", C.frequencies("call_allele_count"))
    gt = "call_genotype"
    return c.select(
        "variant_index", "sample_index", *_pair("call_allele_count", "ac"), *_pair("f", "af"), C.heterozygosity("call_allele_count").alias("het"),
        C.genotype_index(gt, 2, 2).alias("genotype_index"), F.get(C.complete(gt), F.lit(0)).alias("complete0"), C.alternate_count(gt).alias("alternates"), C.format_genotype(gt).alias("shown"),
    )


@query("z as (select 1) select pk as variant_index, cohort, r as ac0, a as ac1, r / nullif(r + a, 0)::double as af0, a / nullif(r + a, 0)::double as af1 from cc", doubles="af0 af1")
def cohort_alleles(spark: SparkSession, sf: str) -> DataFrame:
    out = agg.cohort_allele_frequencies(agg.count_cohort_alleles(keyed(spark, sf), samples(spark, sf), 2, ploidy=2))
    return out.select("variant_index", "cohort", *_pair("cohort_allele_count", "ac"), *_pair("cohort_allele_frequency", "af"))


@query("z as (select 1) select pk as variant_index, count_if(called and a0 + a1 = 0)::bigint as g00, count_if(called and a0 + a1 = 1)::bigint as g01, count_if(called and a0 + a1 = 2)::bigint as g11 from k group by pk")
def variant_genotypes(spark: SparkSession, sf: str) -> DataFrame:
    out = agg.count_variant_genotypes(keyed(spark, sf), 2, 2)
    return out.select("variant_index", *[F.get("variant_genotype_count", F.lit(i)).alias(n) for i, n in enumerate(("g00", "g01", "g11"))])


@query("""t as (select pk, count_if(called and a0 + a1 = 0) aa, count_if(called and a0 + a1 = 1) ab, count_if(called and a0 + a1 = 2) bb from k group by pk),
u as (select *, aa + ab + bb n, 2 * least(aa, bb) + ab rare from t),
h as (select pk, n, ab, unnest(range((rare % 2)::bigint, (rare + 1)::bigint, 2::bigint)) h, rare from u where n > 0),
w as (select pk, ab, h, h * ln(2.0::double) - lgamma(h + 1) - lgamma((rare - h) / 2 + 1) - lgamma(n - (rare + h) / 2 + 1) lp from h),
m as (select pk, max(lp) mx, max(case when h = ab then lp end) seen from w group by pk),
e as (select w.pk, sum(exp(lp - mx)) total, sum(case when lp <= seen + 1e-9 then exp(lp - mx) end) tail from w join m using (pk) group by w.pk)
select u.pk as variant_index, least(1.0, tail / total) as variant_hwe_p_value from u left join e using (pk)""", doubles="variant_hwe_p_value")
def hardy_weinberg(spark: SparkSession, sf: str) -> DataFrame:
    return hardy_weinberg_test(agg.count_variant_genotypes(keyed(spark, sf), 2, 2)).select("variant_index", "variant_hwe_p_value")


@query("""q as (select pk, si, case when n0 + n1 = 2 then 2 * (1 - (n0 * n0 + n1 * n1) / 4.0::double) end het from k)
select pk as variant_index, cohort, avg(het) as value from q join s using (si) where cohort >= 0 group by all""", doubles="value")
def observed_heterozygosity(spark: SparkSession, sf: str) -> DataFrame:
    return agg.observed_heterozygosity(keyed(spark, sf), samples(spark, sf), 2, ploidy=2)


@query("z as (select 1) select pk as variant_index, case when min((a0 >= -1)::int + (a1 >= -1)::int) = max((a0 >= -1)::int + (a1 >= -1)::int) then 2 else -1 end as ploidy from k group by pk")
def variant_ploidy(spark: SparkSession, sf: str) -> DataFrame:
    return agg.infer_ploidy(keyed(spark, sf), "variant_index")


# Windows

_CB = "cb as (select contig, min(vi) f, max(vi) + 1 as t, max(position) lp from v group by contig),\n"


@query(_CB + """w as (select contig, t, unnest(range(f, t, 50)) start from cb)
select row_number() over (order by contig, start) - 1 as window_index, contig, start, least(start + 100, t) as stop from w""")
def window_by_variant(spark: SparkSession, sf: str) -> DataFrame:
    return win.window_by_variant(variants(spark, sf), 100, 50)


@query(_CB + """w as (select contig, f, unnest(range(5, lp + 5, 150)) p from cb)
select row_number() over (order by contig, p) - 1 as window_index, contig, f + (select count(*) from v where v.contig = w.contig and position < p) as start,
 f + (select count(*) from v where v.contig = w.contig and position < p + 200) as stop from w""")
def window_by_position(spark: SparkSession, sf: str) -> DataFrame:
    return win.window_by_position(variants(spark, sf), 200, 150, 5)


@query(_CB + """b as (select contig, position, vi, count(*) over (partition by contig order by position range between unbounded preceding and 31 preceding) lo,
 count(*) over (partition by contig order by position range between unbounded preceding and 29 following) hi from v)
select vi as window_index, contig, f + lo as start, f + hi as stop from b join cb using (contig)""")
def window_by_locus(spark: SparkSession, sf: str) -> DataFrame:
    return win.window_by_locus(variants(spark, sf), 60, -30)


_IV = "iv as (select distinct p_type contig, n_nationkey ii, 40 * n_nationkey + 3 fp, 40 * n_nationkey + 3 + 7 * (n_nationkey % 4) tp from nation, part),\n"


@query(_CB + _IV + """w as (select contig, ii, f + (select count(*) from v where v.contig = iv.contig and position < fp) st, f + (select count(*) from v where v.contig = iv.contig and position < tp) sp from iv join cb using (contig))
select row_number() over (order by contig, ii) - 1 as window_index, contig, st as start, sp as stop from w where sp > st""")
def window_by_interval(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    iv = table(spark, sf, "nation").crossJoin(F.broadcast(table(spark, sf, "part").select(F.col("p_type").alias("contig")).distinct()))
    iv = iv.select("contig", n.alias("interval_index"), (40 * n + 3).cast("bigint").alias("from_position"), (40 * n + 3 + 7 * (n % 4)).cast("bigint").alias("to_position"))
    return win.window_by_interval(variants(spark, sf), iv)


@query("z as (select 1) select 0::bigint as window_index, 0::bigint as start, count(*) as stop from part")
def window_by_genome(spark: SparkSession, sf: str) -> DataFrame:
    return win.window_by_genome(variants(spark, sf))


_W = _CB + """w0 as (select contig, t, unnest(range(f, t, 50)) start from cb),
w as (select row_number() over (order by contig, start) - 1 wi, contig, start, least(start + 50, t) as stop from w0),\n"""


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    return win.window_by_variant(variants(spark, sf), 50)


@query(_W + """n as (select v.vi, count_if(called)::bigint c from v left join k on k.pk = v.p_partkey group by v.vi)
select wi as window_index, sum(c)::bigint as called, max(c) as most, count(*) as variants from w join n on vi >= start and vi < stop group by wi""")
def window_statistic(spark: SparkSession, sf: str) -> DataFrame:
    v = variants(spark, sf)
    n = calls(spark, sf).groupBy(F.col("variant_key").alias("p_partkey")).agg(F.count_if(C.is_called("call_genotype", 2)).alias("c"))
    values = v.join(n, "p_partkey", "left").select("variant_index", F.coalesce("c", F.lit(0)).alias("c"))
    return win.window_statistic(values, win.window_by_variant(v, 50), [], {"called": F.sum("c"), "most": F.max("c"), "variants": F.count("*")})


# Population genetics

_PI = """ci as (select v.vi, cohort, r::double r, a::double a, r + a n from cc join v on v.p_partkey = cc.pk),
pi as (select vi, cohort, (n * (n - 1) / 2 - r * (r - 1) / 2 - a * (a - 1) / 2) / nullif(n * (n - 1) / 2, 0) val from ci),
dv as (select x.vi, x.cohort c0, y.cohort c1, 1 - (x.r * y.r + x.a * y.a) / nullif(x.n * y.n, 0) val from ci x join ci y on x.vi = y.vi and x.cohort < y.cohort
  union all select vi, cohort, cohort, val from pi),
dw as (select wi, c0, c1, case when count(*) = count(val) then sum(val) end val from w join dv on vi >= start and vi < stop group by all),
fw as (select d.wi, d.c0, d.c1, 1 - ((i.val + j.val) / 2) / nullif(d.val, 0) val, i.val + j.val ii, d.val dd from dw d join dw i on i.wi = d.wi and i.c0 = d.c0 and i.c1 = d.c0 join dw j on j.wi = d.wi and j.c0 = d.c1 and j.c1 = d.c1 where d.c0 < d.c1),
"""


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    v = variants(spark, sf).select(F.col("p_partkey").alias("k"), F.col("variant_index").alias("vi"))
    return agg.count_cohort_alleles(keyed(spark, sf), samples(spark, sf), 2, ploidy=2).join(v, F.col("variant_index") == F.col("k")).select(F.col("vi").alias("variant_index"), "cohort", "cohort_allele_count")


@query(_W + _PI + "z as (select 1) select vi as unit, cohort, val as value from pi", doubles="value")
def diversity(spark: SparkSession, sf: str) -> DataFrame:
    return popgen.diversity(_counts(spark, sf))


@query(_W + _PI + "z as (select 1) select wi as unit, c0 as cohort, val as value from dw where c0 = c1", doubles="value")
def diversity_windowed(spark: SparkSession, sf: str) -> DataFrame:
    return popgen.diversity(_counts(spark, sf), _windows(spark, sf))


@query(_W + _PI + "z as (select 1) select wi as unit, c0 as cohort_0, c1 as cohort_1, val as value from dw union all select wi, c1, c0, val from dw where c0 < c1", doubles="value")
def divergence(spark: SparkSession, sf: str) -> DataFrame:
    return popgen.divergence(_counts(spark, sf), _windows(spark, sf))


@query(_W + _PI + "z as (select 1) select wi as unit, c0 as cohort_0, c1 as cohort_1, val as value from fw", doubles="value")
def fst_hudson(spark: SparkSession, sf: str) -> DataFrame:
    return popgen.Fst(_counts(spark, sf), _windows(spark, sf))


@query(_W + _PI + "z as (select 1) select wi as unit, c0 as cohort_0, c1 as cohort_1, 1 - 2 * ii / nullif(ii + 2 * dd, 0) as value from fw", doubles="value")
def fst_nei(spark: SparkSession, sf: str) -> DataFrame:
    return popgen.Fst(_counts(spark, sf), _windows(spark, sf), "Nei")


@query(_W + _PI + """t as (select wi, c0, c1, -ln(1 - least(greatest(val, 0.0), 1 - 1.1102230246251565e-16)) t from fw)
select a.wi as unit, a.c0 as cohort_0, a.c1 as cohort_1, b.c1 as cohort_2, ((a.t + b.t - d.t) / 2) / (1 + (a.t + b.t + d.t) / 2) as value
from t a join t b on a.wi = b.wi and a.c0 = b.c0 and a.c1 < b.c1 join t d on d.wi = a.wi and d.c0 = a.c1 and d.c1 = b.c1""", doubles="value")
def pbs(spark: SparkSession, sf: str) -> DataFrame:
    return popgen.pbs(popgen.Fst(_counts(spark, sf), _windows(spark, sf)))


@query(_W + _PI + """va as (select v.vi, sum(n0) r, sum(n1) a from k join v on v.p_partkey = k.pk group by v.vi),
nn as (select max(r + a)::bigint n from va),
hs as (select n, sum(1.0::double / i) a1, sum(1.0::double / (i * i)) a2 from nn, (select unnest(range(1, (select n from nn))) i) group by n),
ks as (select n, a1, a2, (n + 1) / (3.0::double * (n - 1)) b1, 2.0::double * (n * n + n + 3) / (9 * n * (n - 1)) b2 from hs),
es as (select a1, (b1 - 1 / a1) / a1 e1, (b2 - (n + 2) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2) e2 from ks),
sg as (select wi, sum((r > 0)::int + (a > 0)::int - 1)::double sv from w join va on vi >= start and vi < stop group by wi)
select d.wi as unit, d.c0 as cohort, (d.val - sv / a1) / sqrt(case when e1 * sv + e2 * sv * (sv - 1) > 0 then e1 * sv + e2 * sv * (sv - 1) end) as value from dw d join sg using (wi), es where d.c0 = d.c1""", doubles="value")
def tajimas_d(spark: SparkSession, sf: str) -> DataFrame:
    vc = agg.count_variant_alleles(keyed(spark, sf), 2, ploidy=2)
    v = variants(spark, sf).select(F.col("p_partkey").alias("k"), F.col("variant_index").alias("vi"))
    vc = vc.join(v, F.col("variant_index") == F.col("k")).select(F.col("vi").alias("variant_index"), "variant_allele_count")
    return popgen.Tajimas_D(_counts(spark, sf), vc, _windows(spark, sf))


_HAP = """sl as (select v.vi, k.si, cohort, 0 slot, a0 al from k join v on v.p_partkey = k.pk join s on s.si = k.si where cohort >= 0
  union all select v.vi, k.si, cohort, 1, a1 from k join v on v.p_partkey = k.pk join s on s.si = k.si where cohort >= 0),
hp as (select wi, cohort, si, slot, string_agg(vi::varchar || ':' || al::varchar, ',' order by vi) h from w join sl on vi >= start and vi < stop group by all),
hn as (select wi, cohort, h, count(*) n from hp group by all),
hf as (select wi, cohort, n / sum(n) over (partition by wi, cohort)::double f, row_number() over (partition by wi, cohort order by n desc, h) r from hn)
"""


@query(_W + _HAP + """select wi as unit, cohort, sum(f * f) as h1, pow(sum(case when r <= 2 then f else 0 end), 2) + sum(case when r > 2 then f * f else 0 end) as h12,
 pow(sum(case when r <= 3 then f else 0 end), 2) + sum(case when r > 3 then f * f else 0 end) as h123, (sum(f * f) - pow(max(case when r = 1 then f end), 2)) / sum(f * f) as h2_h1 from hf group by all""", doubles="h1 h12 h123 h2_h1")
def garud_h(spark: SparkSession, sf: str) -> DataFrame:
    return popgen.Garud_H(indexed(spark, sf), samples(spark, sf), _windows(spark, sf))


# Pairs of variants and samples: dosages are known for full calls


def dosages(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    d = F.nullif(C.collapse_ploidy("call_genotype"), F.lit(-1)).cast("double")
    return (indexed(spark, sf) if of is None else of).select("variant_index", "sample_index", d.alias("dosage"))


def keyed_dosages(spark: SparkSession, sf: str) -> DataFrame:
    """Dosages by part key as variant_index, all of a variant in one partition."""
    known = table(spark, sf, "part").select(F.col("p_partkey").alias("variant_index"))
    return dosages(spark, sf, keyed(spark, sf, True).join(known, "variant_index", "left_semi"))


_D = "dd as (select v.vi, k.si, (a0 + a1)::double d from k join v on v.p_partkey = k.pk where called),\n"
_R2 = """ow as (select v.vi, v.contig, max_by(stop, wi) t from v join w on w.contig = v.contig and w.start <= v.vi group by all having v.vi < max_by(stop, wi)),
pr as (select o.vi i, x.vi j, count(*) n, (avg(y.d * x.d) - avg(y.d) * avg(x.d)) cov, avg(y.d * y.d) - avg(y.d) * avg(y.d) vy, avg(x.d * x.d) - avg(x.d) * avg(x.d) vx from ow o join dd y on y.vi = o.vi join dd x on x.si = y.si and x.vi >= o.vi and x.vi < o.t group by all),
"""


@query(_W + _D + _R2 + "z as (select 1) select i, j, round((case when i = j then 1.0 else cov * cov / (vx * vy) end)::double + 1e-6, 4) as value from pr where i = j or (vx > 1e-12 and vy > 1e-12 and cov * cov / (vx * vy) >= 0.1000001)")
def ld_matrix(spark: SparkSession, sf: str) -> DataFrame:
    v = variants(spark, sf)
    out = ld.ld_matrix(dosages(spark, sf, indexed(spark, sf, True)), v, win.window_by_variant(v, 50), n_samples(spark, sf), 0.1000001)
    return out.select("i", "j", F.round(F.col("value").cast("double") + 1e-6, 4).alias("value"))


@query()
def ld_prune(spark: SparkSession, sf: str) -> DataFrame:
    v = variants(spark, sf)
    return ld.ld_prune(dosages(spark, sf, indexed(spark, sf, True)), v, win.window_by_variant(v, 50), n_samples(spark, sf), 0.2).select("variant_index", "contig")


_IBS = """fr as (select pk vi, si, n1 / (n0 + n1)::double f from k where n0 + n1 > 0),
ib as (select x.si i, y.si j, avg(x.f * y.f + (1 - x.f) * (1 - y.f)) val from fr x join fr y using (vi) group by all),
"""


@query(_IBS + "z as (select 1) select i, j, val as value from ib", doubles="value")
def identity_by_state(spark: SparkSession, sf: str) -> DataFrame:
    return rel.identity_by_state(keyed(spark, sf, True), n_samples(spark, sf), 2, undefined=False)


@query(_IBS + "z as (select avg(val) m from ib where i > j) select i, j, (val - m) / (1 - m) as value from ib, z", doubles="value")
def weir_goudet_beta(spark: SparkSession, sf: str) -> DataFrame:
    return rel.weir_goudet_beta(rel.identity_by_state(keyed(spark, sf, True), n_samples(spark, sf), 2, undefined=False)).where("value is not null")


def _frequencies(d: DataFrame) -> DataFrame:
    return d.groupBy("variant_index").agg((F.avg("dosage") / 2).alias("frequency"))


@query(_D + """af as (select vi, avg(d) / 2 p from dd group by vi),
gr as (select x.si i, y.si j, sum((x.d - 2 * p) * (y.d - 2 * p)) num, sum(2 * p * (1 - p)) den from dd x join dd y using (vi) join af using (vi) group by all)
select i, j, num / den as value from gr where den > 1e-9""", doubles="value")
def genomic_relationship(spark: SparkSession, sf: str) -> DataFrame:
    d = keyed_dosages(spark, sf)
    return rel.genomic_relationship(d, _frequencies(d), n_samples(spark, sf), skipna=True, undefined=False).where("value is not null")


_E = """e as (select vec_id, embedding from embeddings),
ed as (select a.vec_id i, b.vec_id j, list_filter(list_zip(a.embedding, b.embedding), lambda z: z[1] >= 0 and z[2] >= 0) l from e a join e b on a.vec_id % 100 = 0),
"""


@query(_E + "z as (select 1) select i, j, sqrt(coalesce(list_sum(list_transform(l, lambda z: (z[1]::double - z[2]) * (z[1]::double - z[2]))), 0)) as value from ed", doubles="value")
def euclidean_distance(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))
    return rel.pairwise_distance(e, queries=e.where("row_id % 100 = 0"))


@query(_E + """m as (select i, j, len(l) n, list_sum(list_transform(l, lambda z: z[1]::double)) sx, list_sum(list_transform(l, lambda z: z[2]::double)) sy, list_sum(list_transform(l, lambda z: z[1]::double * z[1])) xx, list_sum(list_transform(l, lambda z: z[2]::double * z[2])) yy, list_sum(list_transform(l, lambda z: z[1]::double * z[2])) xy from ed),
r as (select i, j, (xy - sx * sy / n) c, (xx - sx * sx / n) * (yy - sy * sy / n) d from m)
select i, j, case when d > 1e-12 then 1 - c / sqrt(d) end as value from r""", doubles="value")
def correlation_distance(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))
    return rel.pairwise_distance(e, "correlation", e.where("row_id % 100 = 0"))


# Association


@query(_D + """m as (select vi, count(*) n, covar_pop(d, trait) c, var_pop(d) vx, var_pop(trait) vy from dd join s using (si) group by vi)
select vi as variant_index, n, case when vx * n > 1e-9 then c / vx end as beta, case when vx * n > 1e-9 and vy * n > 1e-9 then c * c / vx / vy end as r2 from m""", doubles="beta r2")
def gwas_simple(spark: SparkSession, sf: str) -> DataFrame:
    return assoc.simple_regression(dosages(spark, sf).where("dosage is not null"), samples(spark, sf))


@query(_D + """mn as (select vi, avg(d) m from dd group by vi),
x as (select mn.vi, s.si, trait, coalesce(d, m) d from mn, s left join dd on dd.vi = mn.vi and dd.si = s.si),
x2 as (select mn.vi, s.si, s.trait, coalesce(dd.d, mn.m) d from mn cross join s left join dd on dd.vi = mn.vi and dd.si = s.si),
r as (select vi, count(*) n, covar_pop(d, trait) c, var_pop(d) vx, var_pop(trait) vy from x2 group by vi)
select vi as variant_index, 0::bigint as trait, case when vx * n > 1e-9 then c / vx end as beta, case when vx * n > 1e-9 then (c / vx) / sqrt((vy - c * c / vx) / (n - 2) / vx) end as t_value from r""".replace("x as (select mn.vi, s.si, trait, coalesce(d, m) d from mn, s left join dd on dd.vi = mn.vi and dd.si = s.si),\n", ""), doubles="beta t_value")
def gwas_linear_regression(spark: SparkSession, sf: str) -> DataFrame:
    y = samples(spark, sf).select("sample_index", "trait").toPandas().sort_values("sample_index")["trait"].to_numpy()
    return assoc.gwas_linear_regression(dosages(spark, sf), y, None).select("variant_index", "trait", "beta", "t_value")


@query()
def pca_loadings(spark: SparkSession, sf: str) -> DataFrame:
    _, _, loadings = assoc.pca(dosages(spark, sf), n_samples(spark, sf), 5)
    return loadings


# Pedigrees: parents of a supplier by arithmetic


def pedigree(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("s_suppkey")
    known = i >= 4
    return table(spark, sf, "supplier").select(
        F.lit(0).cast("bigint").alias("ped"), i.alias("id"),
        F.when(known, F.floor((i - 1) / 2)).alias("p"), F.when(known, F.floor((i - 2) / 3)).alias("q"),
    )


_PED = """pd as (select s_suppkey id, case when s_suppkey >= 4 then (s_suppkey - 1) // 2 end p, case when s_suppkey >= 4 then (s_suppkey - 2) // 3 end q from supplier),
"""


@query(_PED + """lk as (select id, p y, 0.5::double w from pd where p is not null union all select id, q, 0.5 from pd where q is not null),
st as (select id x, id y, 1.0::double c from pd union all select x, lk.id, c * w from st join lk on lk.y = st.y)
select 0::bigint as ped, x, y, sum(c) as value from st group by all""", doubles="value")
def pedigree_contribution(spark: SparkSession, sf: str) -> DataFrame:
    return ped.pedigree_contribution(pedigree(spark, sf), Workspace(spark, "contribution"))


_KIN = """kn as (select a.id s, b.id e, greatest(a.id, b.id) x, least(a.id, b.id) y, 1.0::double co from pd a join pd b on a.id <= b.id
  union all select s, e, greatest(nx, ny), least(nx, ny), co / 2 from (
    select s, e, co, unnest(case when x = y then [p] else [p, q] end) nx, case when x = y then q else y end ny from kn join pd on pd.id = kn.x where p is not null) t),
ph as (select s i, e j, sum(case when x = y then co / 2 else 0 end) val from kn group by all)
"""


@query(_PED + _KIN + "select 0::bigint as ped, i, j, val as value from ph where val > 0", doubles="value")
def pedigree_kinship(spark: SparkSession, sf: str) -> DataFrame:
    return ped.pedigree_kinship(pedigree(spark, sf))


@query(_PED + _KIN + "select 0::bigint as ped, i as id, 2 * val - 1 as value from ph where i = j", doubles="value")
def pedigree_inbreeding(spark: SparkSession, sf: str) -> DataFrame:
    return ped.pedigree_inbreeding(pedigree(spark, sf))


@query(_PED + _KIN + """, pr as (select pd.id, p, q, 1 / (a.val - coalesce(b.val, 0) / 4 - coalesce(c.val, 0) / 4 - coalesce(d.val, 0) / 2) sc from pd
  join ph a on a.i = pd.id and a.j = pd.id left join ph b on b.i = pd.p and b.j = pd.p left join ph c on c.i = pd.q and c.j = pd.q left join ph d on d.i = least(pd.p, pd.q) and d.j = greatest(pd.p, pd.q)),
ce as (select id i, id j, sc v from pr union all select p, p, sc / 4 from pr where p is not null union all select q, q, sc / 4 from pr where q is not null
  union all select p, q, sc / 4 from pr where p is not null union all select q, p, sc / 4 from pr where p is not null
  union all select p, id, -sc / 2 from pr where p is not null union all select id, p, -sc / 2 from pr where p is not null
  union all select q, id, -sc / 2 from pr where q is not null union all select id, q, -sc / 2 from pr where q is not null)
select 0::bigint as ped, i, j, sum(v) as value from ce group by all""", doubles="value")
def pedigree_inverse_kinship(spark: SparkSession, sf: str) -> DataFrame:
    return ped.pedigree_inverse_kinship(pedigree(spark, sf))


@query(_PED + """up as (select id, 0 d from pd where id % 37 = 5 union select unnest([pd.p, pd.q]), d + 1 from up join pd using (id) where pd.p is not null and d < 3)
select 0::bigint as ped, pd.id, case when pd.p in (select id from up) then p end as p, case when pd.q in (select id from up) then q end as q from pd where id in (select id from up)""")
def pedigree_sel(spark: SparkSession, sf: str) -> DataFrame:
    p = pedigree(spark, sf)
    return ped.pedigree_sel(p, p.where("id % 37 = 5"), Workspace(spark, "sel"), ancestor_depth=3)


# Probabilities, and the relational idioms of quality control


@query("""pb as (select l_orderkey, l_linenumber, [1 - 5 * l_discount - 5 * l_tax, 5 * l_discount, 5 * l_tax] p from lineitem),
mx as (select *, round(list_max(p), 9) m, len(list_filter(p, lambda x: x = list_max(p))) ties from pb)
select l_orderkey, l_linenumber, case when m < 0.6 or ties > 1 then '-1/-1' when p[1] = list_max(p) then '0/0' when p[2] = list_max(p) then '1/0' else '1/1' end as call, round(p[2] + 2 * p[3] + 1e-8, 6) + 0.0 as dosage from mx""")
def hard_calls(spark: SparkSession, sf: str) -> DataFrame:
    d, t = 5 * F.col("l_discount"), 5 * F.col("l_tax")
    p = table(spark, sf, "lineitem").withColumn("p", F.array(1 - d - t, d, t))
    call = F.array_join(C.hard_call(F.transform("p", lambda x: F.round(x, 9)), 0.6).cast("array<string>"), "/")
    return p.select("l_orderkey", "l_linenumber", call.alias("call"), (F.round(C.dosage_of("p") + 1e-8, 6) + 0.0).alias("dosage"))


@query("""st as (select pk, count_if(called) / (select count(*) from supplier)::double cr, sum(n1) / nullif(sum(n0 + n1), 0)::double af from k group by pk)
select k.pk as variant_index, k.si::int as sample_index, n1::bigint as alternates from k join st using (pk) where cr > 0.1 and least(af, 1 - af) > 0.2""")
def filter_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of the variants that pass call rate and minor allele frequency."""
    c = keyed(spark, sf)
    af = F.get("variant_allele_frequency", F.lit(1))
    good = agg.variant_stats(c, n_samples(spark, sf), 2, ploidy=2).where((F.col("call_rate") > 0.1) & (F.least(af, 1 - af) > 0.2)).select("variant_index")
    return c.join(good, "variant_index", "left_semi").select("variant_index", "sample_index", C.allele_count("call_genotype", 1).cast("bigint").alias("alternates"))


@query("z as (select 1) select vi as variant_index, contig, position from v where contig = (select min(contig) from v) and position between 40 and 400")
def select_region(spark: SparkSession, sf: str) -> DataFrame:
    v = variants(spark, sf)
    first = table(spark, sf, "part").agg(F.min("p_type")).first()[0]
    return v.where((F.col("contig") == first) & F.col("position").between(40, 400)).select("variant_index", "contig", "position")


@query("z as (select 1) select s.si::int as sample_index, cohort, n_name as nation, count(k.pk) as calls from s join supplier p on p.s_suppkey = s.si left join nation on n_nationkey = p.s_nationkey left join k on k.si = s.si and called group by all")
def annotate_samples(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("sample_index"), "s_nationkey").join(n, "s_nationkey", "left")
    called = keyed(spark, sf).where(C.is_called("call_genotype")).groupBy("sample_index").agg(F.count("*").alias("n"))
    out = samples(spark, sf).join(s, "sample_index").join(called, "sample_index", "left")
    return out.select("sample_index", F.col("sample_cohort").alias("cohort"), "nation", F.coalesce("n", F.lit(0)).alias("calls"))


# Models without an SQL form


def _trait(spark: SparkSession, sf: str):  # noqa: ANN202
    return samples(spark, sf).select("sample_index", "trait").toPandas().sort_values("sample_index")["trait"].to_numpy()


@query()
def regenie_loco(spark: SparkSession, sf: str) -> DataFrame:
    d, v, y = dosages(spark, sf), variants(spark, sf), _trait(spark, sf)
    _, _, loco = assoc.regenie(d, v, y, variant_block=500, sample_blocks=5)
    return assoc.regenie_loco_regression(d, v, y, None, loco)


@query()
def pc_relate(spark: SparkSession, sf: str) -> DataFrame:
    n = n_samples(spark, sf)
    proj, _, _ = assoc.pca(dosages(spark, sf), n, 2)
    pcs = proj.pivot(index="sample", columns="component", values="value").to_numpy()
    return rel.pc_relate(keyed(spark, sf, True), pcs, n)


@query()
def gene_test(spark: SparkSession, sf: str) -> DataFrame:
    d, v = dosages(spark, sf), variants(spark, sf)
    w = win.window_by_variant(v, 50)
    betas = assoc.simple_regression(d.where("dosage is not null"), samples(spark, sf)).select("variant_index", F.coalesce("beta", F.lit(0.0)).alias("beta"))
    pairs = ld.ld_matrix(d, v, w, n_samples(spark, sf)).where("value is not null")
    return assoc.genee(betas, pairs, w)
