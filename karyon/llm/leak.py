"""Evaluation texts that leak into training text.

Words are hashed and windows of words embedded by random walks (the CGK
embedding): at each step the walk emits its word and advances or not by a random
bit of the word, so that two walks meet again after insertions and deletions and
edit distance becomes Hamming distance. A few sampled steps of a walk are one
LSH key. Windows have a seventh to a fourteenth of an item's words, and as many
independent walks are taken as reach a stated recall on simulated passages. Of
windows that share a key, those stay that have most words in common place by
place, give or take one. There the two word sequences are aligned exactly: the
alignment with the most matches less half the edits.

Items of bounded size travel to the documents, which are then read once and never
shuffled. Beyond that bound the keys of both meet in one shuffled join.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karyon.plans.workspace import Workspace

_WORD = re.compile(r"[^\W_]+")
_ODD = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Scheme:
    """``share``: the part of an item's words that makes a case. ``samples``: steps
    that one key takes. ``target``: share of simulated cases, with ``edits`` of the
    words changed, that must share a key with their item; ``most_walks`` bounds the
    walks taken for it. ``agree``: the part of a window's words that must be alike
    place by place; simulated cases are held to it too."""

    share: float = 1 / 3
    samples: int = 8
    target: float = 0.98
    edits: float = 0.2
    agree: float = 0.7
    most_walks: int = 32
    trials: int = 150
    seed: int = 20240

    def fitting(self, size: int) -> Walks:
        """Windows for an item of ``size`` words, with all walks that may be taken."""
        return Walks(span_for(size), self.most_walks, self.samples, self.seed)


@dataclass(frozen=True)
class Walks:
    """Windows of ``span`` words, embedded by ``count`` walks of twice as many steps."""

    span: int
    count: int
    samples: int
    seed: int

    @property
    def steps(self) -> int:
        return 2 * self.span

    def sampled(self) -> list[set[int]]:
        rng = np.random.default_rng([self.seed, self.span])
        return [set(rng.choice(self.steps, min(self.samples, self.steps), replace=False).tolist()) for _ in range(self.count)]


def span_for(size: int) -> int:
    """Window length for an item of ``size`` words: the largest of 10, 20, 40, ... up to a seventh; 5, 2 or 1 for short ones."""
    span = next((s for s in (5, 2) if s * 7 <= size), 1)
    step = 10
    while step * 7 <= size:
        span, step = step, step * 2
    return span


def words(text: str) -> list[str]:
    """Lower-case runs of letters and digits."""
    return _WORD.findall(text.lower())


@cache
def _in_words() -> np.ndarray:
    """Whether each character belongs to a word."""
    out = np.zeros(sys.maxunicode + 1, bool)
    for m in _WORD.finditer("".join(map(chr, range(sys.maxunicode + 1)))):
        out[m.start() : m.end()] = True
    return out


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64."""
    x = np.full(n, base, np.uint64)
    x[0] = 1
    return np.cumprod(x)


def _hashed_words(chars: np.ndarray, piece: int = 1 << 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (odd), begin and end of each word among ``chars``.

    A hash is a polynomial in the word's characters, taken as a difference of running
    sums. Pieces end between words.
    """
    base, out, at = 0x9E3779B97F4A7C15, [], 0
    back = pow(base, -1, 1 << 64)
    inside = _in_words().take(chars)
    while at < len(chars):
        end = at + piece
        if end < len(chars):
            between = np.flatnonzero(~inside[at:end])
            if len(between):
                end = at + int(between[-1]) + 1
            else:
                end += int(inside[end:].argmin())
                end = len(chars) if inside[end] else end
        here = inside[at:end]
        change = np.flatnonzero(here[1:] != here[:-1]) + 1
        edges = np.concatenate([[0] * bool(here[0]), change, [len(here)] * bool(here[-1])]).astype(np.int64)
        begin, stop = edges[::2], edges[1::2]
        n = 1 << max(15, len(here).bit_length())
        sums = np.zeros(len(here) + 1, np.uint64)
        terms = chars[at:end].astype(np.uint64)
        terms *= _powers(base, n)[: len(here)]
        np.cumsum(terms, out=sums[1:])
        h = (sums[stop] - sums[begin]) * _powers(back, n)[begin]
        out.append((_mix(h, 0x5851F42D4C957F2D) | np.uint64(1), begin + at, stop + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))


class Texts:
    """The words of texts, as :func:`words` gives them: hashes, and the words themselves where they are asked for."""

    def __init__(self, texts: list[str]):
        self.lower = [t.lower() for t in texts]
        chars = np.frombuffer(b"".join([f"{t} ".encode("utf-32-le", "surrogatepass") for t in self.lower]), "<u4")
        at = np.cumsum([0] + [len(t) + 1 for t in self.lower])
        h, self.begin, self.end = _hashed_words(chars)
        self.at, self.first = at, np.searchsorted(self.begin, at)
        cut = list(zip(self.first[:-1].tolist(), self.first[1:].tolist()))
        short = (h >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
        self.hashes, self.short = [h[x:y] for x, y in cut], [short[x:y] for x, y in cut]

    def words(self, d: int, low: int, high: int) -> list[str]:
        """Words ``low`` to ``high`` of text ``d``."""
        low, high = self.first[d] + low, min(self.first[d] + high, self.first[d + 1])
        return words(self.lower[d][self.begin[low] - self.at[d] : self.end[high - 1] - self.at[d]]) if low < high else []


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    x = (h ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def walk_keys(h: np.ndarray, w: Walks, piece: int = 32768, kind: type = np.uint64) -> np.ndarray:
    """The key of each walk from each position: walks x positions.

    A walk's key is put together from its last step to its first: the key from
    step j on is that of the same or of the next word from step j + 1 on. So all
    positions are walked at once, without following any. The walks are the same for
    keys of 32 bits (``kind``), which are faster but may be equal by chance.
    """
    out = np.empty((w.count, len(h)), kind)
    picked = w.sampled()
    size = out.itemsize * 8
    signed, top, half, odd = np.dtype(f"i{out.itemsize}").type, size - 1, kind(size // 2 - 1), kind(int(_ODD) >> (64 - size) | 1)
    for a in range(0, len(h), piece):
        part = h[a : a + piece + w.steps]
        term = (part >> np.uint64(64 - size)).astype(kind, copy=False)
        n = min(piece, len(h) - a)
        swap, mask = np.empty(max(0, len(part) - 1), kind), np.empty(max(0, len(part) - 1), signed)
        for i, want in enumerate(picked):
            key, begin = np.full(len(part), i + 1, kind), max(want)  # later steps don't count
            for j in range(begin, -1, -1):
                if j == begin or j % 64 == 63:
                    mixed = _mix(part, 1_000_003 * (i + 1) + j // 64)[:-1]
                if j == begin or j % size == top:
                    # The bit of a step stands on top: it becomes a mask by an arithmetic shift.
                    bits = (mixed >> np.uint64(j % 64 // size * size)).astype(kind, copy=False).view(signed) << signed(top - j % size)
                if j != begin:
                    np.right_shift(bits, signed(top), out=mask)
                    np.bitwise_xor(key[1:], key[:-1], out=swap)
                    np.bitwise_and(swap, mask.view(kind), out=swap)
                    key[:-1] ^= swap
                bits += bits
                if j in want:
                    key += term
                    key *= odd
                    if size == 64:
                        key ^= key >> half
            out[i, a : a + n] = key[:n]
    return out


def join_texts(hashes: Iterable[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """One array with ``pad`` empty words after each text; where each text begins."""
    gap, parts, begins, at = np.zeros(pad, np.uint64), [], [], 0
    for h in hashes:
        begins.append(at)
        parts += [h, gap]
        at += len(h) + pad
    return (np.concatenate(parts) if parts else gap), np.array(begins, np.int64)


def window_starts(h: np.ndarray, span: int) -> np.ndarray:
    """Whether a whole window of words, without padding, begins at a position."""
    whole = np.zeros(len(h), bool)
    if len(h) >= span:
        whole[: len(h) - span + 1] = (h[: len(h) - span + 1] != 0) & (h[span - 1 :] != 0)
    return whole


def matches(held: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (place in ``keys``, place in the sorted ``held``) of equal keys."""
    lo = np.searchsorted(held, keys, "left")
    hit = np.flatnonzero(held[np.minimum(lo, len(held) - 1)] == keys) if len(held) else lo[:0]
    lo = lo[hit]
    n = np.searchsorted(held, keys[hit], "right") - lo
    return np.repeat(hit, n), np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def alike(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, span: int, agree: float) -> np.ndarray:
    """Whether windows at ``at`` of ``a`` and ``to`` of ``b`` have ``agree`` of their words in common, in the same place or the next."""
    out = np.zeros(len(at), bool)
    if len(at):
        ours, theirs = sliding_window_view(a, span), sliding_window_view(np.concatenate([b[:1], b, b[-1:]]), span + 2)
    some = max(1, (1 << 18) // span)
    for k in range(0, len(at), some):
        x, y = ours[at[k : k + some]], theirs[to[k : k + some]]
        out[k : k + some] = ((x == y[:, 1:-1]) | (x == y[:, :-2]) | (x == y[:, 2:])).sum(1) >= agree * span
    return out


def _changed(rng: np.random.Generator, h: np.ndarray, rate: float) -> np.ndarray:
    """Words replaced (three of five changes), left out or put in."""
    what, new = rng.random(len(h)), rng.integers(1, 1 << 62, len(h), dtype=np.uint64)
    pairs = np.stack([np.where(what < 0.6 * rate, new, h), new], 1)
    keep = np.stack([(what < 0.6 * rate) | (what >= 0.8 * rate), (what >= 0.8 * rate) & (what < rate)], 1)
    return pairs[keep]


def walks_needed(sizes: list[int], span: int, s: Scheme) -> Walks:
    """As many walks as let ``target`` of simulated cases share a key with their item.

    A case has as many words as leave ``share`` of the item's when ``edits`` of
    them are changed; all words are different.
    """
    rng = np.random.default_rng([s.seed, span])
    at, items, cases = 0, [], []
    for t in range(s.trials):
        size = max(1, sizes[t % len(sizes)])
        item = rng.integers(1, 1 << 62, size, dtype=np.uint64)
        length = min(size, max(span, int(np.ceil(size * s.share / (1 - s.edits)))))
        at = int(rng.integers(0, size - length + 1))
        items.append(item)
        cases.append(_changed(rng, item[at : at + length], s.edits))
    full = Walks(span, s.most_walks, s.samples, s.seed)
    got = []
    for group in (items, cases):
        h, begins = join_texts(group, full.span)
        starts = np.flatnonzero(window_starts(h, span))
        owner = (np.searchsorted(begins, starts, side="right") - 1).astype(np.uint64)
        got.append((h, starts, owner, walk_keys(h, full)[:, starts]))
    met, n = np.zeros(s.trials, bool), 0
    (h, starts, owner, keys), (h2, starts2, owner2, keys2) = got
    while n < s.most_walks:
        mine, theirs = _mix(keys[n] ^ owner * _ODD, 1), _mix(keys2[n] ^ owner2 * _ODD, 1)
        order = np.argsort(mine)
        k2, k = matches(mine[order], theirs)
        good = alike(h, starts[order[k]], h2, starts2[k2], span, s.agree)
        met[owner2[k2[good]].astype(np.int64)] = True
        n += 1
        if met.mean() >= s.target:
            break
    return Walks(span, n, s.samples, s.seed)


def align(pairs: list[tuple[np.ndarray, np.ndarray]], least: list[float] | None = None, batch: int = 32) -> list[tuple[int, float]]:
    """For each (a, b): words of ``a`` matched in order by the best local alignment, and its score.

    A match counts 1; another word, one too many or one too few cost 1/2 each, so
    that redacted names and page headers inside a passage are bridged. Among equal
    scores the most words count; words of scores under ``least`` are given as 0.
    """
    wide = []
    for a, b in pairs:
        gap = np.full(max(0, len(a) - 1), 2, np.uint64)
        wide.append((a, np.concatenate([gap, b, gap])))
    got = align_band(wide, batch)
    return got if least is None else [(hits if score >= x else 0, score) for (hits, score), x in zip(got, least)]


def align_band(pairs: list[tuple[np.ndarray, np.ndarray]], batch: int = 128) -> list[tuple[int, float]]:
    """:func:`align` where word i of ``a`` can only meet words i to i + width of ``b``, width being len(b) - len(a).

    Exact within the band. Score and words travel in one number and one row of the
    band is all that is held, whatever the length of ``a``. Pairs are aligned side
    by side. Words are odd numbers, but for those of ``b`` outside its text.
    """
    out: list[tuple[int, float]] = [(0, 0.0)] * len(pairs)
    width = [len(b) - len(a) + 1 for a, b in pairs]
    order = sorted((k for k in range(len(pairs)) if len(pairs[k][0])), key=lambda k: (width[k], len(pairs[k][0])))
    for begin in range(0, len(order), batch):
        picked = order[begin : begin + batch]
        rows, cols = max(len(pairs[k][0]) for k in picked), max(width[k] for k in picked)
        small = rows < 1 << 14 and 2 * rows + cols < 1 << 16
        kind, shift = (np.int32, 14) if small else (np.int64, 30)
        one = kind(1 << shift)
        a, b = np.zeros((rows, len(picked), 1), np.uint64), np.full((len(picked), rows + cols - 1), 2, np.uint64)
        for x, k in enumerate(picked):
            a[: len(pairs[k][0]), x, 0] = pairs[k][0]
            b[x, : len(pairs[k][1])] = pairs[k][1]
        # Twice the score above ``shift`` bits, matched words below.
        score = np.zeros((len(picked), cols + 1), kind)
        ramp, gain, top = np.arange(cols, dtype=kind) * one, kind(3 * one + 1), np.zeros(len(picked), kind)
        step, best = np.empty((len(picked), cols), kind), np.zeros((len(picked), cols), kind)
        for i in range(rows):
            here = score[:, :cols]
            np.multiply(b[:, i : i + cols] == a[i], gain, out=step)
            step += here
            np.maximum(step, score[:, 1:], out=step)
            step -= one
            step *= step >= one
            step += ramp
            np.maximum.accumulate(step, axis=1, out=here)
            here -= ramp
            np.maximum(best, here, out=best)
        np.maximum(top, best.max(1), out=top)
        for x, k in enumerate(picked):
            out[k] = (int(top[x]) & ((1 << shift) - 1), (int(top[x]) >> shift) / 2)
    return out


def scores_band(pairs: list[tuple[np.ndarray, np.ndarray]], batch: int = 256) -> np.ndarray:
    """The scores of :func:`align_band` without the words, in small numbers."""
    out = np.zeros(len(pairs))
    width = [len(b) - len(a) + 1 for a, b in pairs]
    order = sorted((k for k in range(len(pairs)) if len(pairs[k][0])), key=lambda k: (width[k], len(pairs[k][0])))
    for begin, end in _batches(np.array([len(pairs[k][1]) for k in order], np.int64), batch, 1 << 20):
        picked = order[begin:end]
        rows, cols = max(len(pairs[k][0]) for k in picked), max(width[k] for k in picked)
        kind = np.int16 if 2 * rows + cols < 1 << 14 else np.int64
        # Half of a word's hash will do: words that differ may only raise a score here.
        a, b = np.zeros((len(picked), rows), np.uint32), np.full((len(picked), rows + cols - 1), 2, np.uint32)
        for x, k in enumerate(picked):
            a[x, : len(pairs[k][0])] = pairs[k][0]
            b[x, : len(pairs[k][1])] = pairs[k][1]
        a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
        # Twice the score and the place in the band, so that a word too many is a step along the band at no cost.
        ramp = np.repeat(np.arange(cols + 1, dtype=kind)[:, None], len(picked), 1)
        score, best, least, three, one = ramp.copy(), ramp[:cols].copy(), ramp[:cols], kind(3), kind(1)
        step, other, same = np.empty_like(best), np.empty_like(best), np.empty(best.shape, bool)
        for i in range(rows):
            np.equal(b[i : i + cols], a[i], out=same)
            np.multiply(same.view(np.int8), three, out=step)
            step += score[:cols]
            np.subtract(score[1:], one, out=other)
            np.maximum(step, other, out=step)
            step -= one
            np.maximum(step, least, out=step)
            # The greatest so far along the band, by doubling.
            reach = 1
            while reach < cols:
                np.maximum(step[reach:], step[:-reach], out=other[reach:])
                other[:reach] = step[:reach]
                step, other = other, step
                reach *= 2
            score[:cols] = step
            np.maximum(best, step, out=best)
        out[picked] = (best - ramp[:cols]).max(0) / 2
    return out


def _spread(texts: list[np.ndarray], which: np.ndarray, pad: int, none: int) -> tuple[np.ndarray, np.ndarray]:
    """One array of those texts (sixteen bits a word, odd numbers) that ``which`` names, ``none`` ``pad`` times around each; where each of ``which`` begins."""
    used, at = np.unique(which, return_inverse=True)
    gap, parts = np.full(pad, none, np.uint16), []
    for k in used.tolist():
        parts += [gap, texts[k]]
    begins = np.cumsum([pad] + [len(texts[k]) + pad for k in used.tolist()])
    return np.concatenate([*parts, gap]), begins[at]


def bounds_band(a: np.ndarray, b: np.ndarray, block: int, enough: float) -> np.ndarray:
    """Numbers that the scores of :func:`scores_band` don't exceed, for a column of ``a`` and ``b`` each; those over ``enough`` may be given as it.

    The band, of len(b) - len(a) + 1 places, is cut into blocks. A word counts as matched
    in a block if it stands anywhere in it, a step to the next block costs what one place
    does, one to the block after it as many as a block has and one, and one to any other
    block twice as many and one. The places are whole blocks, and the columns a multiple of eight.
    """
    rows, n = a.shape
    cols = len(b) - rows + 1
    small = 2 * enough <= 100 and block <= 8
    kind = np.int8 if small else np.int16 if 2 * rows + 2 * block < 1 << 14 else np.int64
    same = np.empty((cols, n), bool)
    parts, some = same.view(np.uint64).reshape(cols // block, block, n // 8), np.empty((cols // block, n // 8), np.uint64)
    matched = some.view(np.int8)
    # Numpy takes the greater of two arrays faster than that of an array and a number.
    none, most, score, step, moved = np.zeros((5, cols // block, n), kind)
    most += kind(100)
    best, top = np.zeros((2, n), kind)
    one, three, next_, far = kind(1), kind(3), kind(block + 1), kind(2 * block + 1)
    for i in range(rows):
        np.equal(b[i : i + cols], a[i], out=same)
        np.bitwise_or.reduce(parts, axis=1, out=some)
        np.multiply(matched, three, out=step)
        step += score
        np.maximum(step[:-1], score[1:], out=step[:-1])
        step -= one
        np.maximum(step, none, out=step)
        np.maximum.reduce(step, axis=0, out=top)
        np.maximum(best, top, out=best)
        top -= far
        np.subtract(step[:-1], one, out=moved[1:])
        np.maximum(step, moved, out=score)
        np.subtract(step[:-2], next_, out=moved[2:])
        np.maximum(score[2:], moved[2:], out=score[2:])
        np.maximum(score, top, out=score)
        if small:
            np.minimum(score, most, out=score)
    return best / 2


def _deletes(w: str) -> set[str]:
    return {w[:i] + w[i + 1 :] for i in range(len(w))} | {w}


class Speller:
    """Item words that a misread word may stand for: those that become alike by leaving out one letter at most on either side."""

    def __init__(self, known: set[str], bound: int = 1_000_000):
        self.bound, self.seen, self.variants = bound, {}, defaultdict(set)
        for t in known:
            if len(t) > 2:
                for x in _deletes(t):
                    self.variants[x].add(t)

    def __call__(self, token: str) -> tuple[str, ...]:
        got = self.seen.get(token)
        if got is None:
            if len(self.seen) > self.bound:
                self.seen.clear()
            found = {t for x in _deletes(token) for t in self.variants.get(x, ())} if len(token) > 1 else ()
            got = self.seen[token] = tuple(sorted(found))
        return got


class Item:
    """One item's words."""

    def __init__(self, text: str, bound: int = 20_000):
        tokens, read = words(text), Texts([text])
        self.hashes, self.short = read.hashes[0], read.short[0]
        self.size, self.known, self.bound = len(tokens), dict(zip(tokens, self.hashes.tolist())), bound
        self.read: dict[str, int] = {}

    def corrected(self, tokens: list[str], speller: Speller) -> np.ndarray:
        """Hashes of the words, misread ones replaced by the item's; even numbers for what is no word of the item."""
        read, known = self.read, self.known
        if len(read) > self.bound:
            read.clear()
        for t in tokens:
            if t not in read:
                read[t] = known[t] if t in known else next((known[x] for x in speller(t) if x in known), 2)
        return np.array([read[t] for t in tokens], np.uint64)

    def places(self, shift: np.ndarray) -> Iterator[tuple[int, int]]:
        """Where the parts of a text around windows whose (sorted) shifts against the item are about the same begin and end.

        They are as wide as the shifts of such windows and a sixth of the item and
        twelve words on either side: so far may a passage drift from them by words
        put in or left out.
        """
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(shift) > self.size // 2 + 8, [True]]))
        for x, y in zip(cuts[:-1], cuts[1:]):
            yield int(shift[x]) - self.size // 6 - 12, int(shift[y - 1]) + self.size // 6 + 12 + self.size


def _batches(tall: np.ndarray, most: int, cells: int) -> Iterator[tuple[int, int]]:
    """Runs of up to ``most`` pairs that take ``cells`` numbers at most if each takes as many as the longest; or of eight pairs."""
    at = 0
    while at < len(tall):
        n = min(most, len(tall) - at)
        n = max(min(8, n), int((np.maximum.accumulate(tall[at : at + n]) * np.arange(1, n + 1) <= cells).sum()))
        yield at, at + n
        at += n


def _part(h: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Words from ``begin`` to ``end``, even numbers where the text has none."""
    out = np.full(end - begin, 2, np.uint64)
    low, high = max(0, begin), max(0, min(end, len(h)))
    if low < high:
        out[low - begin : high - begin] = h[low:high]
    return out


def hopeful(todo: np.ndarray, texts: Texts, items: list[Item], share: float, block: int = 4, cells: int = 1 << 19) -> np.ndarray:
    """Which rows (text, item, begin, end) of ``todo`` may have a third of the score that is due, by :func:`bounds_band`."""
    out = np.ones(len(todo), bool)
    lengths, sizes = np.array([len(h) for h in texts.hashes]), np.array([i.size for i in items])
    size, begin = sizes[todo[:, 1]], todo[:, 2]
    width = todo[:, 3] - begin - size + 1
    order = np.lexsort((size, width))
    for at, stop in _batches((size + width)[order], 2048, cells):
        picked = order[at:stop]
        rows, n = int(size[picked].max()), -(-len(picked) // 8) * 8
        tall = rows - 1 + -(-int(width[picked].max()) // block) * block
        # Beyond a part's end its text goes on, which may only raise the bound.
        text, starts = _spread(texts.short, todo[picked, 0], tall, 2)
        word, begins = _spread([i.short for i in items], todo[picked, 1], rows, 0)
        a, b = np.zeros((rows, n), np.uint16), np.full((tall, n), 2, np.uint16)
        a[:, : len(picked)] = sliding_window_view(word, rows)[begins].T
        low = np.clip(begin[picked], -tall, lengths[todo[picked, 0]])
        b[:, : len(picked)] = sliding_window_view(text, tall)[starts + low].T
        due = share * size[picked] / 3
        out[picked] = bounds_band(a, b, block, due.max())[: len(picked)] >= due
    return out


def verify(todo: np.ndarray, texts: Texts, items: list[Item], speller: Speller, share: float) -> set[tuple[int, int]]:
    """(text, item) of the parts, rows (text, item, begin, end) of ``todo``, that are cases.

    A case has ``share`` of the item's words and a score of 0.6 or more for each.
    What falls short, but scores a third of what is due, may hold misread words:
    it is aligned again with those corrected. What can't score as much by
    :func:`hopeful` isn't aligned at all.
    """
    found: set[tuple[int, int]] = set()
    if len(todo) >= 16:
        todo = todo[hopeful(todo, texts, items, share)]
    parts = [tuple(t) for t in todo.tolist()]
    for again in (False, True):
        pairs = []
        for d, i, begin, end in parts:
            if again:
                low = max(0, begin)
                h, begin, end = items[i].corrected(texts.words(d, low, max(0, end)), speller), begin - low, end - low
            else:
                h = texts.hashes[d]
            pairs.append((items[i].hashes, _part(h, begin, end)))
        score = scores_band(pairs)
        due = np.array([share * items[i].size for _, i, _, _ in parts])
        likely = np.flatnonzero(score >= 0.6 * due)  # of fewer words there are too few
        for k, (hits, top) in zip(likely, align_band([pairs[k] for k in likely])):
            if hits >= due[k] and top >= 0.6 * hits:
                found.add(parts[k][:2])
        parts = [t for t, ok in zip(parts, score >= due / 3) if ok and t[:2] not in found]
    return found


class Finder:
    """The keys of items with windows of one length, and the search of documents for them."""

    def __init__(self, items: list[Item], w: Walks, s: Scheme, speller: Speller):
        self.w, self.s, self.speller, self.items = w, s, speller, items
        self.words, self.begins = join_texts((i.hashes for i in items), w.span)
        self.sizes = np.array([i.size for i in items], np.int64)
        at = np.flatnonzero(window_starts(self.words, w.span))
        # Keys of 32 bits will do, since windows are compared.
        self.held, self.shift = [], np.uint32(32 - min(24, max(16, (len(at) * 16).bit_length())))
        for row in walk_keys(self.words, w, kind=np.uint32):
            order = np.argsort(row[at], kind="stable")
            keys = row[at][order]
            bitmap = np.zeros(1 << (32 - int(self.shift)), bool)
            bitmap[keys >> self.shift] = True
            self.held.append((keys, at[order], bitmap))

    def candidates(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document window, item, place in item) of windows that share a key and are alike."""
        starts = window_starts(h, self.w.span)
        pos, at = [], []
        for row, (held, places, bitmap) in zip(walk_keys(h, self.w, kind=np.uint32), self.held):
            likely = np.flatnonzero(bitmap.take(row >> self.shift) & starts)
            k, i = matches(held, row[likely])
            k, i = likely[k], places[i]
            good = alike(self.words, i, h, k, self.w.span, self.s.agree)
            pos.append(k[good])
            at.append(i[good])
        at = np.concatenate(at)
        own = np.searchsorted(self.begins, at, side="right") - 1
        return np.concatenate(pos), own, at - self.begins[own]

    def search(self, texts: Texts) -> set[tuple[int, int]]:
        """(index of text, index of item) of every case in the texts' words."""
        h, begins = join_texts(texts.hashes, self.w.span)
        pos, own, place = self.candidates(h)
        if not len(pos):
            return set()
        doc = np.searchsorted(begins, pos, side="right") - 1
        shift = pos - begins[doc] - place
        order = np.lexsort((shift, own, doc))
        doc, own, shift = doc[order], own[order], shift[order]
        size = self.sizes[own]
        new = (np.diff(doc) != 0) | (np.diff(own) != 0) | (np.diff(shift) > size[1:] // 2 + 8)
        first, last = np.flatnonzero(np.concatenate([[True], new])), np.flatnonzero(np.concatenate([new, [True]]))
        begin, end = shift[first] - size[first] // 6 - 12, shift[last] + size[last] // 6 + 12 + size[last]
        todo = np.stack([doc[first], own[first], begin, end], 1)
        return verify(todo, texts, self.items, self.speller, self.s.share)


def _chunks(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``chars`` characters."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= chars):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def _plan(sizes: DataFrame, s: Scheme) -> dict[int, Walks]:
    """The walks for each window length in use; ``sizes`` has size (words) and n, a row per size."""
    by_span: dict[int, list[int]] = defaultdict(list)
    for r in sizes.orderBy("size").collect():  # as many rows as there are different sizes
        by_span[span_for(r["size"])].append(r["size"])
    return {span: walks_needed(found, span, s) for span, found in by_span.items()}


def leaked(documents: DataFrame, items: DataFrame, scheme: Scheme = Scheme(), held_words: int = 500_000, chunk_chars: int = 2_000_000, ws: Workspace | None = None) -> DataFrame:
    """(doc_id, item_id) of each document that carries a passage of an item.

    ``documents``: doc_id, text; ``items``: item_id, item_text; other columns are
    ignored. A case: at least ``scheme.share`` of the item's words stand in one
    place of the text, in order, by the alignment of :func:`align` with a score of
    0.6 or more per matched word. Null, blank and wordless texts and items give
    none; a document is reported once per item; texts that have one item_id are
    items of their own, reported under it. Whole texts are read.

    Items of up to ``held_words`` words are broadcast and the documents read in one
    pass. Beyond that the keys are joined: see :func:`_joined`.
    """
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    held = items.where("item_id is not null and item_text is not null").select("item_id", "item_text").distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"item_id": b["item_id"], "item_text": b["item_text"], "size": [len(words(t)) for t in b["item_text"]]})

    ws = ws or Workspace(documents.sparkSession, "leak")
    held = ws.save(held.mapInPandas(count, "item_id bigint, item_text string, size bigint").where("size > 0"), "items", words=F.sum("size"))
    total = held.facts["words"] or 0
    if not total:
        return texts.limit(0).select("doc_id", F.lit(0).cast("bigint").alias("item_id"))
    walks = _plan(held.groupBy("size").agg(F.count("*").alias("n")), scheme)
    if total > held_words:
        return _joined(texts, held, walks, scheme, ws)
    shared = documents.sparkSession.sparkContext.broadcast([(r["item_id"], r["item_text"], r["size"]) for r in held.select("item_id", "item_text", "size").collect()])

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups = defaultdict(list)
        for i, t, size in shared.value:
            groups[span_for(size)].append((i, Item(t)))
        speller = Speller({t for g in groups.values() for _, x in g for t in x.known})
        finders = [([i for i, _ in g], Finder([x for _, x in g], walks[span], scheme, speller)) for span, g in groups.items()]
        for b in batches:
            ids, all_texts, out = b["doc_id"].to_numpy(), b["text"].tolist(), []
            for at, end in _chunks(all_texts, chunk_chars):
                read = Texts(all_texts[at:end])
                for names, finder in finders:
                    out += [(ids[at + d], names[i]) for d, i in finder.search(read)]
            yield pd.DataFrame(out, columns=["doc_id", "item_id"]).astype(np.int64)

    return texts.mapInPandas(find, "doc_id bigint, item_id bigint").distinct()


def _joined(texts: DataFrame, held: DataFrame, walks: dict[int, Walks], scheme: Scheme, ws: Workspace, bits: int = 26) -> DataFrame:
    """The search for items of any number: keys of windows meet in a join.

    A bitmap of 2^``bits`` keys, put together per word of 64 before it is sent,
    keeps keys that no item has from the shuffle; it drops none that one has. Windows
    that share a key are not compared, which could only find more. Only
    documents that share a key are shuffled, once for each item they may carry.
    """
    spark = ws.spark
    named = ws.save(held.withColumn("item", F.concat_ws("-", F.col("item_id").cast("string"), F.md5("item_text"))), "named")

    def keys_of(text: str, only: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        h = Texts([text]).hashes[0]
        for span, w in walks.items():
            if only in (None, span):
                full, _ = join_texts([h], span)
                at = np.flatnonzero(window_starts(full, span))
                if len(at):
                    for row in walk_keys(full, w):
                        yield (row[at] * np.uint64(2 * span + 1)).view(np.int64), at

    def item_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for item, t, size in zip(b["item"], b["item_text"], b["size"]):
                for keys, at in keys_of(t, span_for(size)):
                    yield pd.DataFrame({"key": keys, "item": item, "place": at})

    known = ws.save(named.mapInPandas(item_keys, "key bigint, item string, place bigint"), "keys")
    slots = known.select(F.shiftrightunsigned("key", 64 - bits).alias("slot"))
    cells = slots.select(F.shiftright("slot", 6).alias("cell"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bit"))
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    filled = cells.toPandas()  # 2^(bits - 6) rows at most
    bitmap[filled["cell"].to_numpy(np.int64)] = filled["bit"].to_numpy(np.int64)
    sent = spark.sparkContext.broadcast(bitmap)

    def doc_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_bits = sent.value
        for b in batches:
            for d, t in zip(b["doc_id"], b["text"]):
                for keys, at in keys_of(t):
                    slot = keys.view(np.uint64) >> np.uint64(64 - bits)
                    there = (held_bits.view(np.uint64)[(slot >> np.uint64(6)).view(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
                    if there.any():
                        yield pd.DataFrame({"key": keys[there], "doc_id": d, "pos": at[there]})

    met = texts.mapInPandas(doc_keys, "key bigint, doc_id bigint, pos bigint").join(known, "key").select("doc_id", "item", (F.col("pos") - F.col("place")).alias("shift")).distinct()
    met = ws.save(met, "met")
    # Shifts of one (document, item): as many as the document has words at most.
    pairs = met.groupBy("doc_id", "item").agg(F.array_sort(F.collect_list("shift")).alias("shifts"))
    docs = texts.join(met.select("doc_id").distinct(), "doc_id", "left_semi").distinct()
    whole = pairs.join(docs, "doc_id").join(named.select("item", "item_id", "item_text"), "item")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, i, t, it, shifts in zip(b["doc_id"], b["item_id"], b["text"], b["item_text"], b["shifts"]):
                item = Item(it)
                todo = np.array([(0, 0, *part) for part in item.places(np.asarray(shifts, np.int64))])
                if verify(todo, Texts([t]), [item], Speller(set(item.known)), scheme.share):
                    out.append((d, i))
            yield pd.DataFrame(out, columns=["doc_id", "item_id"]).astype(np.int64)

    return whole.mapInPandas(check, "doc_id bigint, item_id bigint").distinct()
