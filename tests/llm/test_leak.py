import random
import tracemalloc

import numpy as np

from karyon.llm import leak
from karyon.llm.leak import Item, Scheme, Speller, Texts, Walks, align, align_band, bounds_band, leaked, scores_band, span_for, verify, walk_keys, walks_needed, words

D, I = "doc_id long, text string, item_id long", "item_id long, item_text string, text string"  # noqa: E741


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


VOCABULARY = ["".join(random.Random(i).choices("abcdefghijklmnop", k=random.Random(i).randrange(2, 9))) for i in range(1500)]


def test_align_is_the_best_local_alignment():
    rng = np.random.default_rng(0)
    pairs = [(rng.integers(3, 8, rng.integers(1, 12)).astype(np.uint64), rng.integers(3, 8, rng.integers(1, 15)).astype(np.uint64)) for _ in range(60)]
    got = align(pairs, [0.0] * len(pairs), batch=7)
    for (a, b), (hits, score) in zip(pairs, got):
        best = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1, j + 1] = max(0, best[i, j] + (1 if a[i] == b[j] else -0.5), best[i, j + 1] - 0.5, best[i + 1, j] - 0.5)
        assert abs(best.max() - score) < 1e-4 and hits >= score - 1e-6
    wide = [(a, np.concatenate([np.full(4, 2, np.uint64), b, np.full(len(a) + 9, 2, np.uint64)])) for a, b in pairs]
    assert scores_band(wide, 7).tolist() == [score for _, score in align_band(wide, 9)]


def test_planted_passages(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randrange(80, 160)), "x") for i in range(30)] + [(90, "one two three four five six seven", "x"), (91, None, ""), (92, " ", ""), (0, None, "")]
    docs, want = [], set()
    for d in range(240):
        body = prose(rng, 400).split()
        i = rng.randrange(30)
        w = items[i][1].split()
        if d % 4 == 0:  # half of the item, with names redacted, words misread, a page header inside
            part = w[len(w) // 4 : len(w) // 4 + int(0.55 * len(w))]
            part = ["[X.]" if rng.random() < 0.06 else (t[:-1] + "z" if rng.random() < 0.05 and len(t) > 3 else t.upper()) for t in part]
            part[20:20] = ["Page", "7", "of", "9", "—"]
            body[200:200] = part
            want.add((d, i))
        elif d % 4 == 1:  # a short sentence only, or scattered phrases
            body[100:100] = w[:12]
            body[300:300] = w[40:48]
        docs.append((d, "\n ".join(body), 5))
    docs += [(1000, None, 5), (1001, "", 5), (1002, "so: ONE two, three four; five six seven!", 5), (1003, items[3][1], 5), (1003, items[3][1], 5)]
    want |= {(1002, 90), (1003, 3)}
    for held_words in (500_000, 100):  # broadcast, joined
        got = {(r.doc_id, r.item_id) for r in leaked(spark.createDataFrame(docs, D), spark.createDataFrame(items, I), held_words=held_words).collect()}
        assert got == want


def test_changed_passages_of_short_items_are_found(spark):
    rng = random.Random(12)
    items = [(i, prose(rng, rng.randrange(70, 100)), "x") for i in range(40)]
    docs = []
    for d in range(160):
        w = items[d % 40][1].split()
        part = w[10 : 10 + round(0.45 * len(w))]
        for j in rng.sample(range(len(part)), len(part) // 10):
            part[j] = f"changed{j}"
        docs.append((d, " ".join([prose(rng, 150), *part, prose(rng, 150)]), 5))
    got = {(r.doc_id, r.item_id) for r in leaked(spark.createDataFrame(docs, D), spark.createDataFrame(items, I)).collect()}
    assert got == {(d, d % 40) for d in range(160)}


def test_long_text_and_empty(spark):
    rng = random.Random(9)
    item = prose(rng, 100)
    long = prose(rng, 300_000) + " " + item + " " + prose(rng, 1000)
    items = spark.createDataFrame([(1, item, "")], I)
    assert [tuple(r) for r in leaked(spark.createDataFrame([(7, long, 0)], D), items).collect()] == [(7, 1)]
    assert leaked(spark.createDataFrame([], D), items).count() == 0
    assert leaked(spark.createDataFrame([(7, long, 0)], D), spark.createDataFrame([], I)).count() == 0


def test_texts_of_one_item_id_are_all_searched(spark):
    rng = random.Random(21)
    one, two = prose(rng, 90), prose(rng, 150)
    docs = spark.createDataFrame([(1, prose(rng, 40) + " " + one, 0), (2, two + " " + prose(rng, 40), 0), (3, prose(rng, 300), 0)], D)
    items = spark.createDataFrame([(5, one, "a"), (5, two, "b"), (5, two, "b")], I)
    for held_words in (500_000, 10):
        assert sorted(tuple(r) for r in leaked(docs, items, held_words=held_words).collect()) == [(1, 5), (2, 5)]


def test_an_item_of_ten_thousand_words_in_little_memory():
    rng = np.random.default_rng(3)
    a = rng.integers(1, 1 << 60, 10_000).astype(np.uint64)
    b = np.concatenate([rng.integers(1, 1 << 60, 3000).astype(np.uint64), a[2000:7000], rng.integers(1, 1 << 60, 7000).astype(np.uint64)])
    tracemalloc.start()
    assert align([(a, b)]) == [(5000, 5000.0)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6


def test_walks_reach_the_stated_recall():
    s = Scheme()
    for size in (40, 80, 160, 300, 1000):
        w = walks_needed([size], span_for(size), s)
        assert w.count < s.most_walks and size / 14 <= w.span <= size / 7


def test_words():
    assert words("The Cr 12,300_x—ÉTÉ") == ["the", "cr", "12", "300", "x", "été"]
    assert Scheme().fitting(6).span <= 2


def test_bounds_are_not_below_scores():
    rng = np.random.default_rng(5)
    for rows, cols, n in ((30, 12, 64), (9, 4, 8), (70, 40, 16)):
        a, b = rng.integers(1, 9, (rows, n)) * 2 + 1, rng.integers(1, 9, (rows + cols - 1, n)) * 2 + 1
        b[5 : 5 + rows // 2] = a[: rows // 2]
        scores = scores_band([(a[:, k].astype(np.uint64), b[:, k].astype(np.uint64)) for k in range(n)], 7)
        for block, enough in ((4, 1e9), (4, 6.0), (8, 1e9), (1, 1e9)):
            if cols % block == 0:
                bounds = bounds_band(a.astype(np.uint16), b.astype(np.uint16), block, enough)
                assert (bounds >= np.minimum(scores, enough)).all()
                assert (bounds >= scores).all() or enough < 1e9


def test_stock_phrases_are_not_aligned_and_no_case_is_lost(monkeypatch):
    rng = random.Random(31)
    stock = prose(rng, 8).split()
    bodies = [prose(rng, rng.randrange(90, 150)).split() for _ in range(20)]
    items = [Item(" ".join(w[:40] + stock + w[40:])) for w in bodies]
    texts, todo, want = [], [], set()
    for d in range(30):
        own = d % 20
        kept = [t[:-1] + "z" if rng.random() < 0.3 and len(t) > 3 else t for t in bodies[own][: len(bodies[own]) // 2]] if d % 3 == 0 else []
        texts.append(" ".join([prose(rng, 120), *kept[:40], *stock, *kept[40:], prose(rng, 200)]))
        at = 120 + len(kept[:40])
        todo += [(d, i, at - 40 - x.size // 6 - 12, at - 40 + x.size // 6 + 12 + x.size) for i, x in enumerate(items)]
        want |= {(d, own)} if kept else set()
    read, speller, todo, aligned = Texts(texts), Speller({t for x in items for t in x.known}), np.array(todo), []
    whole = set().union(*(verify(todo[k : k + 15], read, items, speller, 1 / 3) for k in range(0, len(todo), 15)))  # too few for the bound
    monkeypatch.setattr(leak, "scores_band", lambda pairs: aligned.append(len(pairs)) or scores_band(pairs))
    assert verify(todo, read, items, speller, 1 / 3) == whole == want
    assert aligned[0] < len(todo) / 5


def test_texts_have_the_words_of_their_letters():
    texts = ["The Cr 12,300_x—ÉTÉ", "", " ", "İstanbul straße ǅ a\u0301b \ud800x \x00y 漢字_かな", "x" * 200_000 + " end " + "ab ba " * 40_000, "end", "한국어 ½ x² _"]
    read, known = Texts(texts), {}
    for d, t in enumerate(texts):
        found = words(t)
        assert read.words(d, 0, len(found) + 5) == found and read.words(d, 1, 3) == found[1:3]
        assert len(read.hashes[d]) == len(found) and (read.hashes[d] & np.uint64(1)).all()
        assert all(known.setdefault(w, h) == h for w, h in zip(found, read.hashes[d].tolist()))
    assert len(set(known.values())) == len(known)
    assert Texts([]).hashes == [] and [len(h) for h in Texts([""]).hashes] == [0]


def test_keys_of_both_widths_are_alike_together():
    rng = np.random.default_rng(6)
    h = rng.integers(1, 1 << 62, 400, dtype=np.uint64)[rng.integers(0, 400, 5000)] | np.uint64(1)
    h[3000:3100] = h[1000:1100]
    for span in (1, 10, 40, 80):
        w = Walks(span, 3, 8, 7)
        wide, narrow = walk_keys(h, w, 700), walk_keys(h, w, 900, np.uint32)
        for x, y in zip(wide, narrow):
            same = x[:2500, None] == x[None, 2500:]
            assert same.any() and np.array_equal(same, y[:2500, None] == y[None, 2500:])
