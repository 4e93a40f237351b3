"""BGEN 1.2 files, layout 2: unphased diploid biallelic probabilities.

A pass over the file's block headers lists the variants' places (the metafile);
tasks then decode ranges of variants.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karyon.plans.workspace import Workspace
from karyon.sources.files import open_fs


def _open(path: str):
    fs, inner = open_fs(path)
    return fs.open_input_file(inner)


def read_header(path: str) -> dict:
    """Where variants start, their number, that of samples, compression, embedded sample ids."""
    with _open(path) as f:
        offset, size, variants, samples = struct.unpack("<IIII", f.read(16))
        magic = f.read(4)
        if magic not in (b"bgen", b"\0\0\0\0"):
            raise ValueError(f"{path} is not a BGEN file")
        f.seek(4 + size - 4)
        flags = struct.unpack("<I", f.read(4))[0]
        if (flags >> 2) & 15 != 2:
            raise NotImplementedError("only layout 2 is read")
        ids = None
        if flags >> 31:
            f.seek(4 + size)
            _, n = struct.unpack("<II", f.read(8))
            ids = [f.read(struct.unpack("<H", f.read(2))[0]).decode() for _ in range(n)]
    return {"first": offset + 4, "variants": variants, "samples": samples, "compression": flags & 3, "ids": ids}


def metafile(path: str) -> Iterator[tuple]:
    """(variant_index, id, rsid, contig, position, alleles, offset, length) of each variant."""
    head = read_header(path)
    with _open(path) as f:
        f.seek(head["first"])
        text = lambda k: f.read(struct.unpack("<H" if k == 2 else "<I", f.read(k))[0]).decode()
        for i in range(head["variants"]):
            vid, rsid, contig = text(2), text(2), text(2)
            pos, n = struct.unpack("<IH", f.read(6))
            alleles = [text(4) for _ in range(n)]
            size = struct.unpack("<I", f.read(4))[0]
            yield i, vid, rsid, contig, pos, alleles, f.tell(), size
            f.seek(f.tell() + size)


def decode(block: bytes, compression: int) -> np.ndarray:
    """Probabilities (samples x 3), NaN where missing, of one genotype block."""
    if compression:
        size = struct.unpack("<I", block[:4])[0]
        if compression == 1:
            block = zlib.decompress(block[4:])
        else:
            import zstandard

            block = zstandard.ZstdDecompressor().decompress(block[4:], max_output_size=size)
    n, alleles, low, high = struct.unpack("<IHBB", block[:8])
    if alleles != 2 or (low, high) != (2, 2):
        raise NotImplementedError("only diploid biallelic variants are read")
    ploidy = np.frombuffer(block, np.uint8, n, 8)
    phased, bits = block[8 + n], block[9 + n]
    if phased:
        raise NotImplementedError("phased probabilities are not read")
    raw = np.frombuffer(block, np.uint8, offset=10 + n)
    if bits in (8, 16, 32):
        values = raw.view({8: "<u1", 16: "<u2", 32: "<u4"}[bits])[: 2 * n].astype(np.float64)
    else:
        stream = np.unpackbits(raw, bitorder="little")[: 2 * n * bits].reshape(2 * n, bits)
        values = (stream * (2.0 ** np.arange(bits))).sum(1)
    p = values.reshape(n, 2) / (2**bits - 1)
    out = np.column_stack([p, 1 - p.sum(1)])
    out[(ploidy & 0x80) > 0] = np.nan
    return out


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Sample ids of a .sample file: the first column after the header and type rows."""
    ids = spark.read.csv(path, sep=" ", header=True)
    first = ids.columns[0]
    return ids.select(F.col(first).alias("sample_id")).where(F.col(first) != "0")


_META = "variant_index bigint, id string, variant_id string, contig string, variant_position bigint, variant_allele array<string>, at bigint, size bigint"


def read_metafile(spark: SparkSession, path: str, ws: Workspace | None = None, batch: int = 10_000) -> DataFrame:
    """The metafile as a written table, :func:`metafile`'s fields in its order.

    Where a variant begins is only known from the one before it, so one task reads
    the headers; it holds ``batch`` of them, and neither they nor the table pass
    through the driver.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _META.split(", ")]
        for b in batches:
            for _ in range(len(b)):
                rows = metafile(path)
                while part := list(islice(rows, batch)):
                    yield pd.DataFrame(part, columns=names)

    return (ws or Workspace(spark, "bgen")).save(spark.range(0, 1, 1, 1).mapInPandas(read, _META), "metafile")


def read_bgen(spark: SparkSession, path: str, sample_path: str | None = None, per_task: int = 100, first: int = 0, stop: int | None = None) -> dict[str, DataFrame]:
    """Tables variants, samples, calls (call_genotype_probability, call_dosage; null where missing).

    ``first`` and ``stop`` bound the variants; blocks of others aren't read.
    """
    head = read_header(path)
    meta = read_metafile(spark, path)
    if meta.where(F.size("variant_allele") != 2).limit(1).count():
        raise NotImplementedError("only biallelic variants are read")
    stop = head["variants"] if stop is None else min(stop, head["variants"])
    meta = meta.where((F.col("variant_index") >= first) & (F.col("variant_index") < stop)).repartitionByRange(max(1, -(-max(0, stop - first) // per_task)), "variant_index")
    ids = head["ids"] or [f"sample_{i}" for i in range(head["samples"])]
    if sample_path:
        ids = [r["sample_id"] for r in read_samples(spark, sample_path).collect()]
    samples = spark.createDataFrame(list(enumerate(ids)), "sample_index int, sample_id string")
    compression = head["compression"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with _open(path) as f:
            for b in batches:
                for v, at, size in b[["variant_index", "at", "size"]].itertuples(index=False):
                    f.seek(at)
                    p = decode(f.read(size), compression)
                    dosage = pd.array(p[:, 1] + 2 * p[:, 2], "Float64")
                    gone = np.isnan(p[:, 0])
                    dosage[gone] = pd.NA
                    yield pd.DataFrame({"variant_index": v, "sample_index": np.arange(len(p), dtype=np.int32), "call_genotype_probability": [None if g else x for g, x in zip(gone, p)], "call_dosage": dosage})

    calls = meta.select("variant_index", "at", "size").mapInPandas(read, "variant_index bigint, sample_index int, call_genotype_probability array<double>, call_dosage double")
    return {"variants": meta.drop("at", "size"), "samples": samples, "calls": calls}


def pack_probability(calls: DataFrame, bits: int = 8) -> DataFrame:
    """Probabilities of het and hom alt as scaled whole numbers (0: missing)."""
    if bits not in (8, 16):
        raise ValueError("probabilities are packed into 8 or 16 bits")
    top = 2**bits - 2
    at = lambda i: F.coalesce(F.round(F.get("call_genotype_probability", F.lit(i)) * top) + 1, F.lit(0)).cast("int")
    return calls.withColumn("packed", F.array(at(1), at(2))).drop("call_genotype_probability", "call_dosage")


def unpack_probability(packed: DataFrame, bits: int = 8) -> DataFrame:
    top = 2**bits - 2
    at = lambda i: F.when(F.get("packed", F.lit(i)) > 0, (F.get("packed", F.lit(i)) - 1) / top)
    p1, p2 = at(0), at(1)
    return packed.withColumns({"call_genotype_probability": F.when(p1.isNotNull() & p2.isNotNull(), F.array(1 - p1 - p2, p1, p2)), "call_dosage": p1 + 2 * p2}).drop("packed")


def bgen_to_parquet(spark: SparkSession, path: str, out: str, region: tuple[int, int] | None = None, bits: int | None = None) -> None:
    """Write the tables of a BGEN file; of variants in ``region`` [from, to), with packed
    probabilities if ``bits`` is given."""
    tables = read_bgen(spark, path)
    inside = F.lit(True) if region is None else (F.col("variant_index") >= region[0]) & (F.col("variant_index") < region[1])
    calls = tables["calls"].where(inside)
    for name, df in (("variants", tables["variants"].where(inside)), ("samples", tables["samples"]), ("calls", pack_probability(calls, bits) if bits else calls)):
        df.write.mode("errorifexists").parquet(f"{out}/{name}")
