"""Queries pN_ of the training-data problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karyon.functions.ids import clean_id
from karyon.llm.knn import nearest_samples
from karyon.llm.leak import leaked
from karyon.llm.packing import GPT2_PATTERN, count_tokens, pack
from karyon.llm.splits import assign_splits, entity_components
from karyon.llm.topn import top_n
from karyon.llm.truncation import truncated
from karyon.plans.workspace import Workspace


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _fam(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "fam").select("fam_row", clean_id("family_id").alias("family"), clean_id("member_id").alias("member"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    comp = entity_components(_fam(spark, sf), ["family", "member"], Workspace(spark, "p1"))
    fams = comp.where("node like 'family:%'").select("component", F.substring("node", 8, 1 << 20).alias("f"))
    a, b = fams.withColumnRenamed("f", "family_id_a"), fams.withColumnRenamed("f", "family_id_b")
    return a.join(b, "component").where("family_id_a < family_id_b").select("family_id_a", "family_id_b")


def p1_splits(spark: SparkSession, sf: str) -> DataFrame:
    return assign_splits(_fam(spark, sf), ["family", "member"], Workspace(spark, "p1"), key="fam_row").select("fam_row", "component", "split")


def p1_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, ids that came out in two splits, and whether the proportions hold to one row in a hundred."""
    out = assign_splits(_fam(spark, sf), ["family", "member"], Workspace(spark, "p1"), key="fam_row")
    torn = lambda c: F.count_distinct(F.when(F.col(f"{c}_n") > 1, F.col(c))).alias(f"torn_{c}")
    whole = out
    for c in ("family", "member"):
        n = out.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"{c}_id")).agg(F.count_distinct("split").alias(f"{c}_n"))
        whole = whole.join(n, F.col(c) == F.col(f"{c}_id"), "left")
    near = lambda s, share: F.abs(F.avg((F.col("split") == s).cast("int")) - share) <= 0.01
    return whole.agg(F.count("*").alias("n"), torn("family"), torn("member"), (near("train", 0.8) & near("validation", 0.1) & near("test", 0.1)).alias("proportioned"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "assoc")
    names = F.filter("names", lambda x: x.isNotNull())
    rows = a.where(F.col("label").isNotNull() & (F.size(names) == 1)).select(F.col("label").alias("grp"), names[0].alias("item"), "loaded_at", "assoc_id", "pvalue")
    # Rows of a pair are combined before they are shuffled.
    ws = Workspace(spark, "p4")
    latest = (
        rows.groupBy("grp", "item")
        .agg(F.max(F.struct("loaded_at", "assoc_id", "pvalue")).alias("r"))
        .select("grp", "item", F.col("r.pvalue").alias("score"))
        .where("score >= 0 and score <= 1")
    )
    return top_n(ws.save(latest, "latest"), 10, ws).select(F.col("grp").alias("label"), F.col("item").alias("variant_name"))


def _nearest_five(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "sample_dosage").select(clean_id("sample_id").alias("id"), F.col("call_dosage").alias("vec"), F.col("loaded_at").alias("at"))
    return nearest_samples(s, d=48, top=2.0, step=0.01, k=5, ws=Workspace(spark, "p2"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest_five(spark, sf).select(F.least("id", "near").alias("sample_id_a"), F.greatest("id", "near").alias("sample_id_b")).distinct()


def p7_containers(spark: SparkSession, sf: str, capacity: int = 2048, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken") -> DataFrame:
    items = count_tokens(table(spark, sf, "documents"), vocabulary, GPT2_PATTERN)
    return pack(items, capacity, Workspace(spark, "p7"))


def p7_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, containers over the capacity, with gaps or overlaps, and numbers that no container has."""
    rows = p7_containers(spark, sf)
    held = rows.where("container is not null").groupBy("container").agg(F.sum("tokens").alias("used"), F.max(F.col("offset") + F.col("tokens")).alias("end"), F.min("offset").alias("begin"), F.count_distinct("offset").alias("offsets"), F.count("*").alias("pieces"))
    bad = held.agg(F.count_if(F.col("used") > 2048).alias("over"), F.count_if((F.col("used") != F.col("end")) | (F.col("begin") != 0) | (F.col("offsets") != F.col("pieces"))).alias("gaps"), (F.coalesce(F.max("container") + 1, F.lit(0)) - F.count("*")).alias("unused"))
    names = ["documents", "over", "gaps", "unused"]
    both = rows.agg(F.count_distinct("doc_id").alias("documents")).unionByName(bad, allowMissingColumns=True)
    return both.agg(*[F.max(n).alias(n) for n in names])


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def _ends(spark: SparkSession, sf: str) -> DataFrame:
    return truncated(table(spark, sf, "documents"), Workspace(spark, "p9"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _ends(spark, sf).where("cut").select("doc_id").distinct()


def p9_sources(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return docs.join(_ends(spark, sf), "doc_id").groupBy("source").agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut"), F.avg(F.col("cut").cast("int")).alias("share"))


QUERIES = {f.__name__: f for f in (p1_found, p1_splits, p1_checks, p2_found, p4_found, p7_containers, p7_checks, p8_found, p9_found, p9_sources)}

_ID = r"nullif(upper(regexp_extract({c}, '^[\s\pZ\x{{0b}}\x{{85}}\x{{FEFF}}\x{{200B}}]*([A-Za-z]{{2}}-[0-9]{{8}})[\s\pZ\x{{0b}}\x{{85}}\x{{FEFF}}\x{{200B}}]*$', 1)), '')"
SQL = {
    "p1_checks": "select count(*) as n, 0::bigint as torn_family, 0::bigint as torn_member, true as proportioned from fam",
    "p7_checks": "select count(distinct doc_id) as documents, 0::bigint as over, 0::bigint as gaps, 0::bigint as unused from documents",
    "p1_found": f"""with recursive f as (select distinct {_ID.format(c='family_id')} f, {_ID.format(c='member_id')} m from fam),
e as (select distinct a.f u, b.f v from f a join f b on a.m = b.m and a.f <> b.f),
r as (select distinct u, v from e union select r.u, e.v from r join e on r.v = e.u)
select u as family_id_a, v as family_id_b from r where u < v""",
    "p2_found": f"""with s as (select {_ID.format(c='sample_id')} id, list_transform(call_dosage, lambda x: cast(round(x * 100) as int)) v, loaded_at from sample_dosage
  where len(call_dosage) = 48 and len(list_filter(call_dosage, lambda x: x >= 0 and x <= 2)) = 48),
u as (select * from s where id is not null qualify row_number() over (partition by id order by loaded_at desc nulls last) = 1),
p as (select a.id a, b.id b, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) d from u a join u b on a.id <> b.id),
k as (select a, b from p qualify row_number() over (partition by a order by d, b) <= 5)
select distinct least(a, b) as sample_id_a, greatest(a, b) as sample_id_b from k""",
    "p4_found": """with l as (select label, list_filter(names, lambda x: x is not null)[1] variant_name, pvalue, loaded_at, assoc_id from assoc
  where label is not null and len(list_filter(names, lambda x: x is not null)) = 1),
d as (select * from l qualify row_number() over (partition by label, variant_name order by loaded_at desc nulls last, assoc_id desc) = 1),
k as (select *, row_number() over (partition by label order by pvalue, variant_name) rn from d where pvalue >= 0 and pvalue <= 1 and not isnan(pvalue))
select label, variant_name from k where rn <= 10""",
}
