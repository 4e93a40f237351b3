"""PLINK filesets: a Python data source for .bed, text readers for .fam and .bim, a writer.

Reading splits the .bed file into ranges of variants; each task reads only its
range. Codes of two bits: 0 both first allele, 1 missing, 2 heterozygous, 3 both
second allele.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from karyon.sources.files import open_fs

FAM = ["family_id", "member_id", "paternal_id", "maternal_id", "sex", "phenotype"]
BIM = ["contig", "variant_id", "cm_pos", "pos", "a1", "a2"]
#: First three bytes of a .bed file by variants. Fixed values.
MAGIC = bytes([0x6C, 0x1B, 0x01])
#: Alleles by two-bit code. Fixed values.
CALLS = np.array([[0, 0], [-1, -1], [1, 0], [1, 1]], np.int8)
SHIFTS = np.array([0, 2, 4, 6], np.uint8)
#: A byte and a word of missing calls only.
NONE, NONES = 0x55, np.uint64(0x5555555555555555)
#: Ending of .bed files whose runs of variants are zstd frames behind each other. Decompressed they are the .bed file.
PACKED = ".zst"


def read_fam(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """Six columns; ``0`` is unknown (a point) in ids, other codes than 1 and 2 are -1."""
    df = spark.read.csv(path, sep=sep, schema=", ".join(f"{c} string" for c in FAM))
    ids = {c: F.when(F.col(c) == "0", ".").otherwise(F.col(c)) for c in ("family_id", "paternal_id", "maternal_id")}
    codes = {c: F.when(F.col(c).try_cast("int").isin(1, 2), F.col(c).try_cast("tinyint")).otherwise(F.lit(-1).cast("tinyint")) for c in ("sex", "phenotype")}
    return df.withColumns({**ids, **codes})


def read_bim(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Six columns; contig ``0`` is null."""
    df = spark.read.csv(path, sep=sep, schema="contig string, variant_id string, cm_pos float, pos int, a1 string, a2 string")
    return df.withColumn("contig", F.nullif("contig", F.lit("0")))


def with_file_order(df: DataFrame, name: str) -> DataFrame:
    """Number the rows of a text table by (file path, place in the file).

    ``df`` must still know its files. Rows are counted per split, of which there is
    one row on the driver; partitions may hold splits in any order.
    """
    at = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))
    splits = at.groupBy("__file", "__block").agg(F.count("*").alias("n"), F.min("__id").alias("first")).collect()
    base, rows = 0, []
    for r in sorted(splits, key=lambda r: (r["__file"], r["__block"])):
        rows.append((r["__file"], r["__block"], base - r["first"]))
        base += r["n"]
    shift = df.sparkSession.createDataFrame(rows, "__file string, __block bigint, __shift bigint")
    # As many rows as there are splits.
    out = at.join(F.broadcast(shift), ["__file", "__block"])
    return out.withColumn(name, F.col("__id") + F.col("__shift")).drop("__file", "__block", "__id", "__shift")


def _known(raw: np.ndarray, width: int, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, sample and code of what isn't missing, in order; words of 32 missing codes are passed over."""
    flat = np.concatenate([raw, np.full(-len(raw) % 8, NONE, np.uint8)])
    word = np.flatnonzero(flat.view(np.uint64) != NONES)
    byte = (word[:, None] * 8 + np.arange(8)).ravel()
    code = ((flat[byte][:, None] >> SHIFTS) & 3).ravel()
    row, sample = np.repeat(byte // width, 4), (byte[:, None] % width * 4 + np.arange(4)).ravel()
    keep = (code != 1) & (sample < samples)
    return row[keep], sample[keep], code[keep]


@dataclass
class VariantRange(InputPartition):
    """Variants from ``first`` to before ``stop``; those of a compressed file with its frames: variants, first byte, bytes."""

    first: int
    stop: int
    frames: list[tuple[int, int, int]] | None = None


class BedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.samples = int(options["samples"])
        self.variants = int(options["variants"])
        self.per_task = int(options.get("variantspertask", 10_000))
        self.packed = str(options.get("packed", "false")).lower() == "true"
        self.first = max(0, int(options.get("first", 0)))
        self.stop = min(self.variants, int(options.get("stop", self.variants)))
        self.width = (self.samples + 3) // 4
        if str(options.get("counta1", "false")).lower() == "true":
            raise ValueError("only calls that count the second allele are read")

    def partitions(self) -> list[VariantRange]:
        if not self.path.endswith(PACKED):
            return [VariantRange(a, min(a + self.per_task, self.stop)) for a in range(self.first, self.stop, self.per_task)]
        fs, inner = open_fs(self.path + ".index")
        with fs.open_input_stream(inner) as f:
            frames = json.loads(f.read())
        out: list[VariantRange] = []
        at = 0
        for n, begin, size in frames:
            if at < self.stop and at + n > self.first:
                if not out or out[-1].stop - out[-1].first >= self.per_task:
                    out.append(VariantRange(at, at, []))
                out[-1].frames.append((n, begin, size))
                out[-1].stop += n
            at += n
        return out

    def read(self, part: VariantRange) -> Iterator[pa.RecordBatch]:
        fs, inner = open_fs(self.path)
        with fs.open_input_file(inner) as f:
            if part.frames is None:
                if f.read(3) != MAGIC:
                    raise ValueError(f"{self.path} is not a .bed file by variants")
                for at in range(part.first, part.stop, self._rows()):
                    n = min(self._rows(), part.stop - at)
                    f.seek(3 + at * self.width)
                    yield self._batch(at, np.frombuffer(f.read(n * self.width), np.uint8))
                return
            at = part.first
            for n, begin, size in part.frames:
                f.seek(begin)
                raw = np.frombuffer(pa.decompress(f.read(size), n * self.width, codec="zstd"), np.uint8)
                for x in range(0, n, self._rows()):
                    low, high = max(self.first, at + x), min(self.stop, at + min(n, x + self._rows()))
                    if low < high:
                        yield self._batch(low, raw[(low - at) * self.width : (high - at) * self.width])
                at += n

    def _rows(self) -> int:
        """Variants at a time: a million bytes, or a million calls one by one."""
        return max(1, min(256, (1 << 20) // max(1, self.width if self.packed else self.samples)))

    def _batch(self, at: int, raw: np.ndarray) -> pa.RecordBatch:
        n = len(raw) // self.width if self.width else 0
        if self.packed:
            row, sample, code = _known(raw, self.width, self.samples)
            ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (sample.astype(np.int32), CALLS.sum(1)[code].astype(float))]
            return pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), *lists], ["variant_index", "idx", "val"])
        codes = ((raw.reshape(n, -1)[:, :, None] >> SHIFTS) & 3).reshape(n, -1)[:, : self.samples]
        calls = CALLS[codes].reshape(-1)
        gt = pa.ListArray.from_arrays(pa.array(np.arange(0, len(calls) + 1, 2, dtype=np.int32)), pa.array(calls))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(at, at + n), self.samples)), pa.array(np.tile(np.arange(self.samples, dtype=np.int32), n)), gt], ["variant_index", "sample_index", "call_genotype"])


class BedDataSource(DataSource):
    """``spark.read.format("plink_bed")`` with options path, samples, variants; of variants from ``first`` to before ``stop``.

    With ``packed`` a variant is one row: its samples with a known call and their
    dosages of the first allele counted, which :func:`packed_rows` takes as they are.
    """

    @classmethod
    def name(cls) -> str:
        return "plink_bed"

    def schema(self) -> str:
        if str(self.options.get("packed", "false")).lower() == "true":
            return "variant_index bigint, idx array<int>, val array<double>"
        return "variant_index bigint, sample_index int, call_genotype array<tinyint>"

    def reader(self, schema) -> BedReader:  # noqa: ANN001
        return BedReader(self.options)


def read_plink(spark: SparkSession, path: str | None = None, *, bed_path: str | None = None, bim_path: str | None = None, fam_path: str | None = None, fam_sep: str = " ", bim_sep: str = "\t", bim_int_contig: bool = False, first: int = 0, stop: int | None = None) -> dict[str, DataFrame]:
    """Tables variants, samples, calls of a fileset: by ``path`` without suffix, or three paths.

    ``packed`` has the calls' dosages by variant, as the matrix operators take them.
    ``first`` and ``stop`` bound the variants; others aren't read from the .bed file.

    variant_contig numbers contigs by first appearance (or is the contig's own
    number); alleles are (a1, a2) and calls count a2... as codes say.
    """
    if (path is None) == (bed_path is None and bim_path is None and fam_path is None):
        raise ValueError("either path or all of bed_path, bim_path and fam_path")
    if path is None and not (bed_path and bim_path and fam_path):
        raise ValueError("bed_path, bim_path and fam_path go together")
    bed, bim, fam = (f"{path}.bed", f"{path}.bim", f"{path}.fam") if path else (bed_path, bim_path, fam_path)
    if path:
        fs, inner = open_fs(bed + PACKED)
        if fs.get_file_info(inner).type == pafs.FileType.File:
            bed += PACKED
    v = with_file_order(read_bim(spark, bim, bim_sep), "variant_index")
    s = with_file_order(read_fam(spark, fam, fam_sep), "sample_index").withColumn("sample_index", F.col("sample_index").cast("int"))
    if bim_int_contig:
        v = v.withColumn("variant_contig", F.col("contig").cast("int"))
    else:
        begin = v.groupBy("contig").agg(F.min("variant_index").alias("f")).collect()  # one row per contig
        names = [r["contig"] for r in sorted(begin, key=lambda r: r["f"])]
        code = F.lit(None).cast("int")
        for i, c in enumerate(names):
            code = F.when(F.col("contig").eqNullSafe(F.lit(c)), F.lit(i)).otherwise(code)
        v = v.withColumn("variant_contig", code)
    v = v.select("variant_index", "variant_contig", F.col("contig"), F.col("pos").alias("variant_position"), "variant_id", "cm_pos", F.array("a1", "a2").alias("variant_allele"))
    spark.dataSource.register(BedDataSource)
    n_variants, n_samples = v.count(), s.count()
    stop = n_variants if stop is None else min(stop, n_variants)
    bed_of = lambda packed: spark.read.format("plink_bed").option("path", bed).option("samples", n_samples).option("variants", n_variants).option("first", first).option("stop", stop).option("packed", packed).load()
    inside = v.where((F.col("variant_index") >= first) & (F.col("variant_index") < stop))
    return {"variants": inside, "samples": s.withColumnRenamed("member_id", "sample_id"), "calls": bed_of("false"), "packed": bed_of("true")}


def write_plink(tables: dict[str, DataFrame], path: str, rows_per_part: int = 4096, compress: bool = False) -> None:
    """Write path.bed, .bim and .fam from diploid biallelic tables.

    Tasks encode runs of variants, each starting from missing calls, into rows in the
    shared folder; the driver only joins these byte streams, run by run, into the one
    file that the format asks for. With ``compress`` it is path.bed.zst, each run being a
    frame, with the frames' places in path.bed.zst.index: a file whose calls are mostly
    missing is then a hundredth as large.
    """
    from karyon.plans.sparse import runs, whole_rows
    from karyon.plans.workspace import Workspace

    spark = tables["calls"].sparkSession
    v, s, c = tables["variants"], tables["samples"], tables["calls"]
    if v.where(F.size("variant_allele") != 2).limit(1).count():
        raise ValueError("only diploid, biallelic calls can be written")
    n_samples = s.count()
    width = (n_samples + 3) // 4
    per_run = max(1, min(rows_per_part, (1 << 23) // max(1, width)))
    x, y = F.get("call_genotype", F.lit(0)), F.get("call_genotype", F.lit(1))
    code = F.when(F.size("call_genotype") != 2, F.lit(4)).when((x < 0) | (y < 0), F.lit(1)).otherwise(F.element_at(F.array(F.lit(0), F.lit(2), F.lit(3)), (x + y + 1).cast("int")))
    # Each variant comes with a mark, as sample -1; calls of other variants are left out.
    values = c.select("variant_index", F.col("sample_index").cast("int").alias("sample"), code.cast("int").alias("code")).unionByName(v.select("variant_index", F.lit(-1).alias("sample"), F.lit(1).alias("code")))
    rows = runs(values.withColumn("run", F.floor(F.col("variant_index") / per_run)), "run", "variant_index", "sample", "code")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_rows(batches, 1 << 14):
            for k, run in enumerate(b.row):
                here = slice(b.ptr[k], b.ptr[k + 1])
                at, sample, codes = b.col[here], b.of["sample"][here].astype(np.int64), b.of["code"][here]
                own = np.unique(at[sample < 0])
                place = np.searchsorted(own, at)
                known = (sample >= 0) & (place < len(own))
                known[known] = own[place[known]] == at[known]
                place, sample, codes = place[known], sample[known], codes[known]
                odd = int((codes > 3).sum() + (sample >= n_samples).sum())
                cell = place * n_samples + sample
                odd += len(cell) - len(np.unique(cell))
                data = np.full((len(own), width), NONE, np.uint8)
                if n_samples % 4 and len(own):
                    data[:, -1] &= (1 << 2 * (n_samples % 4)) - 1
                if not odd:
                    np.bitwise_xor.at(data.reshape(-1), place * width + sample // 4, ((codes ^ 1) << (sample % 4 * 2)).astype(np.uint8))
                held = data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([run], pa.int64()), pa.array([len(own)], pa.int64()), pa.array([odd], pa.int64()), pa.array([pa.compress(held, codec="zstd", asbytes=True) if compress else held], pa.binary())], ["run", "n", "odd", "data"])

    done = Workspace(spark, "bed").save(rows.mapInArrow(encode, "run bigint, n bigint, odd bigint, data binary"), "runs", odd=F.sum("odd"))
    if done.facts["odd"]:
        raise ValueError("only diploid, biallelic calls can be written, one of a variant and sample")
    fs, inner = open_fs(path + ".bed" + PACKED * compress)
    frames, size = [], 0
    with fs.open_output_stream(inner, compression=None) as f:  # else its ending alone would have it compressed again
        head = pa.compress(MAGIC, codec="zstd", asbytes=True) if compress else MAGIC
        f.write(head)
        size += len(head)
        for r in done.where("n > 0").orderBy("run").toLocalIterator():
            f.write(r["data"])
            frames.append((r["n"], size, len(r["data"])))
            size += len(r["data"])
    if compress:
        fs, inner = open_fs(path + ".bed" + PACKED + ".index")
        with fs.open_output_stream(inner) as f:
            f.write(json.dumps(frames).encode())
    _lines(v.orderBy("variant_index"), path + ".bim", "\t", [F.coalesce("contig", F.lit("0")), F.col("variant_id"), F.coalesce("cm_pos", F.lit(0.0)), F.col("variant_position"), F.get("variant_allele", F.lit(0)), F.get("variant_allele", F.lit(1))])
    zero = lambda x: F.when(F.coalesce(F.col(x), F.lit(".")) == ".", "0").otherwise(F.col(x))
    num = lambda x: F.when(F.coalesce(F.col(x), F.lit(-1)) == -1, 0).otherwise(F.col(x))
    _lines(s.orderBy("sample_index"), path + ".fam", " ", [zero("family_id"), F.col("sample_id"), zero("paternal_id"), zero("maternal_id"), num("sex"), num("phenotype")])


def _lines(df: DataFrame, path: str, sep: str, cols: list) -> None:
    fs, inner = open_fs(path)
    with fs.open_output_stream(inner) as f:
        for r in df.select(F.concat_ws(sep, *[c.cast("string") for c in cols]).alias("line")).toLocalIterator():
            f.write((r["line"] + "\n").encode())


def plink_to_parquet(spark: SparkSession, path: str, out: str, **how) -> None:  # noqa: ANN003
    """Read a fileset and write its tables as Parquet directories."""
    for name, df in read_plink(spark, path, **how).items():
        if name == "packed":  # the calls again
            continue
        df.write.mode("errorifexists").parquet(f"{out}/{name}")


def parquet_to_plink(spark: SparkSession, path: str, out: str) -> None:
    """Write a fileset from tables that :func:`plink_to_parquet` wrote."""
    write_plink({t: spark.read.parquet(f"{path}/{t}") for t in ("variants", "samples", "calls")}, out)
