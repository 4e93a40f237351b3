import struct
import zlib

import numpy as np
import pytest

from karyon.sources import bgen, plink


def test_plink_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    g = rng.integers(0, 3, (37, 11))
    g[5, 3] = -1
    calls = [(v, s, [-1, -1] if g[v, s] < 0 else [int(g[v, s] > 0), int(g[v, s] > 1)]) for v in range(37) for s in range(11)]
    t = {
        "variants": spark.createDataFrame([(v, "2" if v < 20 else "1", f"r{v}", 0.5, v * 10, ["A", "C"]) for v in range(37)], "variant_index long, contig string, variant_id string, cm_pos double, variant_position int, variant_allele array<string>"),
        "samples": spark.createDataFrame([(s, "F", f"s{s}", ".", ".", 1, -1) for s in range(11)], "sample_index int, family_id string, sample_id string, paternal_id string, maternal_id string, sex int, phenotype int"),
        "calls": spark.createDataFrame(calls, "variant_index long, sample_index int, call_genotype array<int>"),
    }
    path = str(tmp_path / "x")
    plink.write_plink(t, path, rows_per_part=10)
    back = plink.read_plink(spark, path)
    got = {(r.variant_index, r.sample_index): sum(r.call_genotype) if min(r.call_genotype) >= 0 else -1 for r in back["calls"].collect()}
    assert got == {(v, s): int(g[v, s]) for v in range(37) for s in range(11)}
    v = back["variants"].orderBy("variant_index").collect()
    assert [r.variant_id for r in v] == [f"r{i}" for i in range(37)] and v[0].variant_contig == 0 and v[36].variant_contig == 1
    s = back["samples"].orderBy("sample_index").first()
    assert (s.sample_id, s.paternal_id, s.sex, s.phenotype) == ("s0", ".", 1, -1)
    with pytest.raises(ValueError):
        plink.read_plink(spark)
    with pytest.raises(ValueError):
        plink.write_plink(t | {"calls": t["calls"].selectExpr("variant_index", "sample_index", "array(0) as call_genotype")}, path + "y")


@pytest.mark.parametrize("compress", [False, True])
def test_plink_of_many_samples_with_few_calls(spark, tmp_path, compress):
    n = 4001
    calls = spark.range(3000).selectExpr("id % 300 variant_index", "cast((id * 37 + id div 300) % 4001 as int) sample_index", "array(cast(id % 2 as int), cast(id div 2 % 2 as int)) call_genotype").dropDuplicates(["variant_index", "sample_index"])
    t = {
        "variants": spark.range(301).selectExpr("id variant_index", "'1' contig", "concat('r', id) variant_id", "0.5D cm_pos", "cast(id as int) variant_position", "array('A', 'C') variant_allele"),
        "samples": spark.range(n).selectExpr("cast(id as int) sample_index", "'F' family_id", "concat('s', id) sample_id", "'.' paternal_id", "'.' maternal_id", "1 sex", "-1 phenotype"),
        "calls": calls,
    }
    path = str(tmp_path / "x")
    plink.write_plink(t, path, rows_per_part=64, compress=compress)
    want = {(r.variant_index, r.sample_index): sum(r.call_genotype) for r in calls.collect()}
    back = plink.read_plink(spark, path)
    packed = {(r.variant_index, int(k)): int(x) for r in back["packed"].collect() for k, x in zip(r.idx, r.val)}
    assert packed == want and back["packed"].count() == 301
    known = back["calls"].where("call_genotype[0] >= 0").collect()
    assert {(r.variant_index, r.sample_index): sum(r.call_genotype) for r in known} == want and back["calls"].count() == 301 * n
    some = plink.read_plink(spark, path, first=60, stop=70)["packed"].collect()
    assert {(r.variant_index, int(k)): int(x) for r in some for k, x in zip(r.idx, r.val)} == {k: x for k, x in want.items() if 60 <= k[0] < 70} and len(some) == 10
    if compress:
        import pyarrow as pa

        raw = pa.input_stream(path + ".bed.zst", compression="zstd").read()
        plink.write_plink(t, path + "y", rows_per_part=64)
        assert raw == (tmp_path / "xy.bed").read_bytes() and (tmp_path / "x.bed.zst").stat().st_size < len(raw) / 10


@pytest.fixture(scope="module")
def wide_fileset(spark, tmp_path_factory):
    """20,000 samples, of which a variant knows one; as the queries write it."""
    path = str(tmp_path_factory.mktemp("wide") / "x")
    plink.write_plink({
        "variants": spark.range(900).selectExpr("id variant_index", "if(id < 500, '2', '1') contig", "concat('r', id) variant_id", "0.5D cm_pos", "cast(id as int) variant_position", "array('A', 'C') variant_allele"),
        "samples": spark.range(20_000).selectExpr("cast(id as int) sample_index", "'F' family_id", "concat('s', id) sample_id", "'.' paternal_id", "'.' maternal_id", "cast(id % 3 as int) sex", "-1 phenotype"),
        "calls": spark.range(900).selectExpr("id variant_index", "cast(id * 22 as int) sample_index", "array(0, 1) call_genotype"),
    }, path, rows_per_part=100, compress=True)
    return path


def test_samples_of_a_compressed_fileset(spark, wide_fileset):
    s = plink.read_plink(spark, wide_fileset)["samples"]
    assert s.count() == 20_000 and s.where("sample_id != concat('s', sample_index) or sex != if(sample_index % 3 = 0, -1, sample_index % 3)").count() == 0


def test_variants_of_a_compressed_fileset(spark, wide_fileset):
    v = plink.read_plink(spark, wide_fileset)["variants"]
    assert v.count() == 900 and v.where("variant_id != concat('r', variant_index) or variant_contig != if(variant_index < 500, 0, 1)").count() == 0


def test_a_region_reads_its_frames_only(spark, wide_fileset):
    reader = plink.BedReader({"path": wide_fileset + ".bed.zst", "samples": 20_000, "variants": 900, "first": 250, "stop": 310, "packed": "true"})
    assert [(p.first, p.stop, len(p.frames)) for p in reader.partitions()] == [(200, 400, 2)]
    got = plink.read_plink(spark, wide_fileset, first=250, stop=310)["packed"].collect()
    assert {r.variant_index: (list(r.idx), list(r.val)) for r in got} == {v: ([22 * v], [1.0]) for v in range(250, 310)}


def test_file_order_of_uneven_parts(spark, tmp_path):
    """Spark orders splits by size; rows are numbered by file name all the same."""
    (tmp_path / "v").mkdir()
    for name, low, high in (("a.bim", 0, 5), ("b.bim", 5, 50_005), ("c.bim", 50_005, 50_010), ("d.bim", 50_010, 51_000)):
        (tmp_path / "v" / name).write_text("".join(f"1\tr{i}\t0\t{i}\tA\tC\n" for i in range(low, high)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")  # b is cut into several splits
    try:
        v = plink.with_file_order(plink.read_bim(spark, str(tmp_path / "v")), "variant_index")
        assert v.where("variant_index != pos").count() == 0 and v.count() == 51_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from karyon.plans.workspace import shared_dir

    none = SimpleNamespace(isDefined=lambda: False)
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none))))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(cluster)


def make_bgen(path, p, bits, compress):
    def text(s, k="<H"):
        return struct.pack(k, len(s)) + s.encode()

    body = b""
    n = p.shape[1]
    for v in range(len(p)):
        missing = np.isnan(p[v, :, 0])
        q = np.nan_to_num(p[v, :, :2])
        scaled = np.rint(q * (2**bits - 1)).astype(np.uint64)
        stream = ((scaled.ravel()[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        block = struct.pack("<IHBB", n, 2, 2, 2) + bytes(np.where(missing, 0x82, 2).astype(np.uint8)) + bytes([0, bits]) + np.packbits(stream.ravel(), bitorder="little").tobytes()
        data = struct.pack("<I", len(block)) + zlib.compress(block) if compress else block
        body += text(f"v{v}") + text(f"rs{v}") + text("1") + struct.pack("<IH", 100 + v, 2) + text("A", "<I") + text("G", "<I") + struct.pack("<I", len(data)) + data
    header = struct.pack("<III", 20, len(p), n) + b"bgen" + struct.pack("<I", (2 << 2) | int(compress))
    path.write_bytes(struct.pack("<I", len(header)) + header + body)


@pytest.mark.parametrize(("bits", "compress"), [(8, True), (16, False), (5, True)])
def test_bgen(spark, tmp_path, bits, compress):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([1, 1, 1], (7, 5))
    p[2, 1] = np.nan
    make_bgen(tmp_path / "x.bgen", p, bits, compress)
    t = bgen.read_bgen(spark, str(tmp_path / "x.bgen"), per_task=3)
    rows = {(r.variant_index, r.sample_index): r for r in t["calls"].collect()}
    assert len(rows) == 35 and rows[2, 1].call_dosage is None and rows[2, 1].call_genotype_probability is None
    assert np.allclose(rows[0, 0].call_genotype_probability, p[0, 0], atol=1.01 / 2**bits)
    assert rows[3, 2].call_dosage == pytest.approx(p[3, 2, 1] + 2 * p[3, 2, 2], abs=3.1 / 2**bits)
    assert [r.sample_id for r in t["samples"].orderBy("sample_index").collect()][:2] == ["sample_0", "sample_1"]
    some = bgen.read_bgen(spark, str(tmp_path / "x.bgen"), first=2, stop=4)["calls"]
    assert {r.variant_index for r in some.collect()} == {2, 3}
    back = {(r.variant_index, r.sample_index): r for r in bgen.unpack_probability(bgen.pack_probability(t["calls"], 16), 16).collect()}
    assert back[2, 1].call_dosage is None and back[3, 2].call_dosage == pytest.approx(rows[3, 2].call_dosage, abs=1e-4)


def test_streaming_stats(spark, tmp_path):
    from karyon.operators.aggregation import variant_stats
    from karyon.streaming.stats import streaming_variant_stats

    rows = [(v, s, [v % 2, s % 2]) for v in range(5) for s in range(6)]
    df = spark.createDataFrame(rows, "variant_index long, sample_index int, call_genotype array<int>")
    for k in range(3):
        df.where(f"sample_index % 3 = {k}").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_variant_stats(stream, 6).writeStream.format("memory").queryName("vs").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.variant_index: (r.n_called, r.n_het) for r in spark.table("vs").collect()}
    assert got == {r.variant_index: (r.n_called, r.n_het) for r in variant_stats(df, 6, 2).collect()}
