"""Text cut off by field limits or in transfer.

A backward character model compares, for the last characters of a value, how
often texts end after them with how often they go on. Letters of capitalised
words, digits of numbers and runs of white space are folded first, so that names
and figures don't thin the counts. Closing lines and marks that were put after a
text are taken off before its end is judged. Contexts have lengths 3, 6, 12 and
24; each backs off to the shorter one, and a language's counts to those of all
languages. The threshold is set for each column and language where fewest texts lie
between cut and whole ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karyon.plans.workspace import Workspace

ORDERS = (3, 6, 12, 24)
#: Marks of omission that may stand after a cut. Fixed values.
MARKS = ("(...)", "[...]", "(…)", "[…]", "…", "...", "�")
#: Characters that end a sentence. Fixed values.
SENTENCE_ENDS = ".?!:;"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[128:] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4


def fold(b: np.ndarray) -> np.ndarray:
    """Folded UTF-8 bytes: ``A`` for a capitalised word with any initials before it,
    ``I`` for another single capital, ``0`` for a number, a full stop for every
    sentence mark, one blank for a run of white space, or a line feed where a new
    line begins that does not go on in lower case."""
    n = len(b)
    if not n:
        return b
    c = _CLASS[b]
    letter = (c == 1) | (c == 2)
    single = c == 2
    single[1:] &= ~letter[:-1]
    single[:-1] &= ~letter[1:]
    initial = np.zeros(n, bool)
    initial[:-3] = single[:-3] & (b[1:-2] == 46) & (c[2:-1] == 4) & (c[3:] == 2)
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    begin = np.maximum.accumulate(np.where(first, np.arange(n, dtype=np.int32), 0))
    drop = letter & ~first & (c[begin] == 2)
    for k in range(3):
        drop[k:] |= initial[: n - k]
    digit = c == 3
    inner = np.zeros(n, bool)
    inner[1:-1] = ((b[1:-1] == 44) | (b[1:-1] == 46)) & digit[:-2] & digit[2:]
    number = digit | inner
    drop[1:] |= number[1:] & number[:-1]
    blank = c == 4
    drop[:-1] |= blank[:-1] & blank[1:]  # the last of a run stays
    out = np.where(c == 2, np.where(single, np.uint8(73), np.uint8(65)), np.where(digit, np.uint8(48), np.where((b == 63) | (b == 33), np.uint8(46), b)))
    lines = np.cumsum(b == 10, dtype=np.int32)
    start = np.maximum.accumulate(np.where(blank & ~np.concatenate([[False], blank[:-1]]), np.arange(n, dtype=np.int32), 0))
    low = np.zeros(n, bool)
    low[:-1] = c[1:] == 1
    has = blank & ((lines - lines[start]) + (b[start] == 10) > 0)
    out = np.where(blank, np.where(has & ~low, np.uint8(10), np.uint8(32)), out)
    return out[~drop]


def soften(v: np.ndarray) -> np.ndarray:
    """Line feeds that follow no full stop, as wrapped lines have them, to blanks."""
    v = v.copy()
    at = np.flatnonzero(v == 10)
    at = at[at > 0]
    v[at[v[at - 1] != 46]] = 32
    return v


def context_hashes(v: np.ndarray) -> list[np.ndarray]:
    """For each order, the hash of the context that ends at each position (shorter
    ones at the start of ``v``)."""
    x = (v.astype(np.uint64) + np.uint64(1)) * _ODD
    x ^= x >> np.uint64(32)

    def longer(h: np.ndarray, g: np.ndarray, k: int, power: np.uint64) -> np.ndarray:
        out = h.copy()
        out[k:] += g[:-k] * power if k < len(g) + 1 else 0
        return out

    with np.errstate(over="ignore"):
        p = [np.uint64(1)]
        for _ in range(24):
            p.append(p[-1] * _BASE)
        two = longer(x, x, 1, p[1])
        three = longer(two, x, 2, p[2])
        six = longer(three, three, 3, p[3])
        twelve = longer(six, six, 6, p[6])
        return [three, six, twelve, longer(twelve, twelve, 12, p[12])]


_GAP = b"\x00"  # stands in no word, number or white space


def folded(texts: list[bytes]) -> list[str]:
    """Each text folded, without white space around it; many are folded at once."""
    if not texts:
        return []
    joined = _GAP.join(t.replace(b"\x00", b" ") for t in texts)
    parts = fold(np.frombuffer(joined, np.uint8)).tobytes().split(_GAP)
    return [p.decode("utf-8", "replace").strip() for p in parts]


def closing(line: str) -> bool:
    """Whether a folded line may be a closing line: not empty, and no sentence."""
    return bool(line) and line[-1] not in SENTENCE_ENDS or line.endswith(("...", "…", "…]"))


def closers(text: str) -> list[str]:
    """The last lines of a folded text that may be closing lines, the last one first; never all of its lines."""
    lines = text.split("\n")
    out = []
    while len(lines) > 1 and closing(lines[-1]):
        out.append(lines.pop())
    return out


def last_bytes(data: np.ndarray, begin: int, end: int, least: int = 1024) -> tuple[bytes, bool]:
    """The end of a text in UTF-8, without white space after it and with at least about ``least`` bytes, and whether that is all of it."""
    size = least
    while True:
        low = max(begin, end - size)
        while low > begin and data[low] & 0xC0 == 0x80:
            low -= 1
        out = data[low:end].tobytes().decode("utf-8", "replace").rstrip().encode()
        if low == begin or len(out) >= least // 2:
            return out, low == begin
        size *= 4


def tails_of(col: pa.Array, least: int = 1024) -> list[tuple[str, list[str], int]]:
    """The folded end of each text, its possible closing lines and a hash of its last 80 bytes.

    Ends are read from the back, as far as lines that may be closing lines and the
    longest context before them reach.
    """
    wide = pa.types.is_large_string(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    out: list = [None] * len(col)
    todo = list(range(len(col)))
    while todo:
        raw = [last_bytes(data, int(offsets[k]), int(offsets[k + 1]), least) for k in todo]
        rest = []
        for k, (end, whole), text in zip(todo, raw, folded([r for r, _ in raw])):
            ends = closers(text)
            if whole or len(text) - sum(map(len, ends)) - len(ends) > 4 * ORDERS[-1] + 64:
                out[k] = (text, ends, np.uint64(xxhash.xxh64_intdigest(end[-80:])).astype(np.int64))
            else:
                rest.append(k)
        todo, least = rest, least * 4
    return out


def judged_end(text: str, ends: list[str], known: frozenset[str]) -> str:
    """The folded end of a text without marks and known closing lines."""
    for line in ends:
        if line not in known:
            break
        text = text[: len(text) - len(line) - 1]
    text = text.rstrip()
    while (mark := next((m for m in MARKS if text.endswith(m)), None)) is not None:
        text = text[: -len(mark)].rstrip()
    return text.rstrip("”»\"'")


def end_hashes(ends: list[str]) -> np.ndarray:
    """For each text and order, the hash of the context at its end, as :func:`context_hashes` has it."""
    last = np.zeros((len(ends), ORDERS[-1] + 1), np.uint8)
    there = np.zeros(last.shape, bool)
    for k, e in enumerate(ends):
        b = e.encode()[-last.shape[1] :]
        if b:
            last[k, -len(b) :] = np.frombuffer(b, np.uint8)
            there[k, -len(b) :] = True
    wrapped = (last[:, 1:] == 10) & (last[:, :-1] != 46) & there[:, :-1]
    last[:, 1:][wrapped] = 32
    x = (last.astype(np.uint64) + np.uint64(1)) * _ODD
    x ^= x >> np.uint64(32)
    x[~there] = 0
    out, total, power = np.empty((len(ends), len(ORDERS)), np.uint64), np.zeros(len(ends), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(ORDERS[-1]):
            total = total + x[:, -1 - i] * power
            power = power * _BASE
            if i + 1 in ORDERS:
                out[:, ORDERS.index(i + 1)] = total
    return out


@dataclass
class Contexts:
    """The contexts whose occurrences are counted, with a table from hash to place."""

    order: np.ndarray
    hash: np.ndarray
    bits: int = 22

    def __post_init__(self) -> None:
        self.by_order = []
        for k in range(len(ORDERS)):
            where = np.flatnonzero(self.order == k)
            where = where[np.argsort(self.hash[where], kind="stable")]
            h = self.hash[where]
            table = np.full(1 << self.bits, -1, np.int32)
            bucket = (h >> np.uint64(64 - self.bits)).astype(np.int64)
            table[bucket] = np.arange(len(h), dtype=np.int32)
            crowded = np.zeros(1 << self.bits, bool)
            if len(h) > 1:
                crowded[bucket[1:][bucket[1:] == bucket[:-1]]] = True
            self.by_order.append((where, h, table, crowded))

    def count(self, v: np.ndarray) -> np.ndarray:
        """Occurrences of each context in folded text."""
        total = np.zeros(len(self.order), np.int64)
        for (where, held, table, crowded), h in zip(self.by_order, context_hashes(v)):
            if not len(held):
                continue
            bucket = (h >> np.uint64(64 - self.bits)).astype(np.int64)
            at = table[bucket]
            maybe = np.flatnonzero(at >= 0)
            at, hm, bm = at[maybe], h[maybe], bucket[maybe]
            full = crowded[bm]
            if full.any():
                at[full] = np.minimum(np.searchsorted(held, hm[full]), len(held) - 1)
            total[where] += np.bincount(at[held[at] == hm], minlength=len(held))
        return total


def valley(counts: np.ndarray, low: float, width: float, odds: tuple[float, float]) -> float:
    """The value between log(odds[0]) and log(odds[1]) about which a histogram of log odds is emptiest.

    ``counts`` begins at ``low``, in bins of ``width``. The middle of the emptiest
    stretch, should there be several equal ones the first.
    """
    smooth = np.convolve(counts, [1, 2, 3, 2, 1], "same")
    a, b = (int(round((np.log(o) - low) / width)) for o in odds)
    least = smooth[a:b].min()
    first = a + int(np.argmax(smooth[a:b] == least))
    last = first
    while last + 1 < b and smooth[last + 1] == least:
        last += 1
    return low + (first + last + 1) / 2 * width


def truncated(
    documents: DataFrame,
    ws: Workspace,
    columns: tuple[str, ...] = ("text",),
    line_share: float = 1e-4,
    context_share: float = 1e-5,
    lang_share: float = 0.005,
    between: tuple[float, float] = (1.0, 16.0),
    prior: float = 2.0,
    lean: float = 64.0,
    pull: float = 100.0,
) -> DataFrame:
    """(doc_id, column, lang, log_odds, cut) of each value of ``columns`` with text.

    ``documents``: doc_id, lang and the columns. ``log_odds``: log of (texts that end
    after the final context) against (times it goes on), over the same for any
    position of the column and language; ``cut`` where it is below the threshold.

    Model: contexts of 24, 12, 6 and 3 characters. The rate of ends of each is
    smoothed by ``prior`` occurrences at the rate of the next shorter one, in all
    texts, and that of a column and language by ``lean`` occurrences at the rate in
    all texts. So a language decides for itself where it has counts, and a text with
    a wrong language is judged by what all have. Ends that are literally alike count once, and a text's
    own end doesn't count for it.

    Threshold: for each column and language where the histogram of its log odds is
    emptiest between the odds ``between``; the histogram of all texts counts for it
    like ``pull`` texts. Columns and languages with under ``lang_share`` of the
    texts are taken together.

    Folded last lines that end at least ``line_share`` of the texts (three at
    least) are closing lines; contexts that end at least ``context_share`` of them
    (two at least) are counted over all characters of all texts. Both sets are
    bounded by their shares, whatever the data: 1 / share entries per order.

    Null and blank texts are left out. A null language is one of its own. An empty
    table gives an empty result.
    """
    spark = ws.spark
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("text")) for c in columns])).alias("r")
    lang = F.lower(F.trim(F.coalesce("lang", F.lit("?")))).alias("lang")
    texts = documents.where("doc_id is not null").select("doc_id", lang, rows).select("doc_id", "lang", "r.column", "r.text")
    texts = texts.where(F.col("text").isNotNull() & F.col("text").rlike(r"(?U)\S"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = tails_of(part["text"])
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["column"], part["lang"], part["size"], pa.array([t for t, _, _ in got], pa.string()), pa.array([c for _, c, _ in got], pa.list_(pa.string())), pa.array([h for _, _, h in got], pa.int64())],
                    ["doc_id", "column", "lang", "size", "tail", "closers", "same"],
                )

    schema = "doc_id bigint, column string, lang string, size bigint, tail string, closers array<string>, same bigint"
    sized = texts.select(F.col("doc_id").cast("bigint"), "column", "lang", F.octet_length("text").cast("bigint").alias("size"), "text")
    tails = ws.save(sized.mapInArrow(read, schema), "tails", n=F.count(F.lit(1)), size=F.sum("size"))
    n, whole = tails.facts["n"], tails.facts["size"]
    if not n:
        return tails.select("doc_id", "column", "lang", F.lit(0.0).alias("log_odds"), F.lit(False).alias("cut"))

    # Groups of a share each: 1 / lang_share rows at most.
    large = tails.groupBy("column", "lang").agg(F.count("*").alias("n"), F.sum("size").alias("size")).where(F.col("n") >= lang_share * n).collect()
    groups = {(r["column"], r["lang"]): i + 1 for i, r in enumerate(sorted(large))}
    base = np.full(len(groups) + 1, n / whole)
    for r in large:
        base[groups[r["column"], r["lang"]]] = r["n"] / r["size"]
    group = F.lit(0)
    for (c, l), i in groups.items():
        group = F.when((F.col("column") == c) & (F.col("lang") == l), i).otherwise(group)

    least = max(3, line_share * n)
    lines = tails.select("same", F.explode("closers").alias("line")).distinct().groupBy("line").count()
    known = spark.sparkContext.broadcast(frozenset(r["line"] for r in lines.where(F.col("count") >= least).collect()))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = [judged_end(t, c, known.value) for t, c in zip(b["tail"].to_pylist(), b["closers"].to_pylist())]
            flat = pa.array(end_hashes(ends).view(np.int64).ravel())
            ctx = pa.ListArray.from_arrays(pa.array(np.arange(len(ends) + 1, dtype=np.int32) * len(ORDERS)), flat)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["column"], b["lang"], b["grp"], b["same"], ctx], ["doc_id", "column", "lang", "grp", "same", "ctx"])

    judged = tails.select("doc_id", "column", "lang", group.cast("int").alias("grp"), "same", "tail", "closers")
    ends = ws.save(judged.mapInArrow(judge, "doc_id bigint, column string, lang string, grp int, same bigint, ctx array<bigint>"), "ends", drop=tails)
    flat = ends.select("grp", "same", F.posexplode("ctx").alias("order", "hash")).distinct()
    each = flat.groupBy("grp", "order", "hash").agg(F.count("*").alias("ends"))
    total = each.groupBy("order", "hash").agg(F.sum("ends").alias("all_ends"), F.map_from_entries(F.collect_list(F.struct("grp", "ends"))).alias("by"))
    counted = total.where(F.col("all_ends") >= max(2, context_share * n)).toPandas()
    shared = spark.sparkContext.broadcast((counted["order"].to_numpy(np.int64), counted["hash"].to_numpy(np.int64).astype(np.uint64)))

    def occur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = Contexts(*shared.value)
        seen: dict[int, np.ndarray] = {}
        for b in batches:
            of = b["grp"].to_numpy(zero_copy_only=False)
            for g in np.unique(of):
                mine = b["text"] if (of == g).all() else b["text"].take(pa.array(np.flatnonzero(of == g)))
                if int(g) not in seen:
                    seen[int(g)] = np.zeros(len(ctx.order), np.int64)
                for piece in _pieces(mine, 1 << 20):
                    seen[int(g)] += ctx.count(soften(fold(piece)))
        for g, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g), pa.int32()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["grp", "at", "n"])

    seen = np.zeros((len(base), len(counted)), np.int64)
    met = texts.select(group.cast("int").alias("grp"), "text").mapInArrow(occur, "grp int, at bigint, n bigint").groupBy("grp", "at").agg(F.sum("n").alias("n")).toPandas()
    seen[met["grp"], met["at"]] = met["n"]
    stats = []
    for at, (order, h, every, by) in enumerate(counted[["order", "hash", "all_ends", "by"]].itertuples(index=False)):
        rest = int(max(seen[:, at].sum(), every))
        stats += [(int(g), int(order), int(h), int(e), int(max(seen[g, at], e)), int(every), rest) for g, e in dict(by).items()]
    table = spark.createDataFrame(stats, "grp int, order int, hash bigint, ends bigint, seen bigint, all_ends bigint, all_seen bigint")
    bases = spark.createDataFrame([(i, float(b)) for i, b in enumerate(base)], "grp int, base double")
    keys = ["doc_id", "column", "lang", "grp", "ctx"]
    met = ends.select(*keys).distinct().select(*keys, F.posexplode("ctx").alias("order", "hash")).join(F.broadcast(table), ["grp", "order", "hash"], "left")
    step = F.when(F.col("ends").isNotNull(), F.struct("order", "ends", "seen", "all_ends", "all_seen"))
    scored = met.groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("chain")).join(F.broadcast(bases), "grp")

    def backed_off(rate: Column, c: Column) -> Column:
        pooled = (c["all_ends"] - 1 + prior * rate) / (c["all_seen"] - 1 + prior)
        return (c["ends"] - 1 + lean * pooled) / (c["seen"] - 1 + lean)

    rate = F.aggregate("chain", F.col("base"), backed_off)
    scored = ws.save(scored.select("doc_id", "column", "lang", "grp", F.log(rate / F.col("base")).alias("log_odds")), "scored", drop=ends)

    low, width, bins = -10.0, 0.125, 240
    bin_ = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("log_odds") - low) / width))).cast("int")
    held = np.zeros((len(base), bins))
    for r in scored.groupBy("grp", bin_.alias("bin")).count().collect():
        held[r["grp"], r["bin"]] = r["count"]
    every = held.sum(0)
    limits = [(i, valley(h + pull * every / every.sum(), low, width, between)) for i, h in enumerate(held)]
    limits = spark.createDataFrame(limits, "grp int, least double")
    return scored.join(F.broadcast(limits), "grp").select("doc_id", "column", "lang", "log_odds", (F.col("log_odds") < F.col("least")).alias("cut"))


def _pieces(col: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The bytes of an Arrow string column, whole texts together up to about ``size``."""
    wide = pa.types.is_large_string(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1]
    if not len(col) or offsets[-1] == offsets[0]:
        return
    data = np.frombuffer(col.buffers()[2], np.uint8)
    at = 0
    while at < len(col):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield data[offsets[at] : offsets[end]]
        at = end
