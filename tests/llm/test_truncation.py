import random

import numpy as np
import pyarrow as pa

from karyon.llm.truncation import Contexts, context_hashes, end_hashes, fold, judged_end, soften, tails_of, truncated, valley

S = "doc_id long, text string, lang string, cut string"


def b(s):
    return np.frombuffer(s.encode(), np.uint8)


def test_fold():
    out = soften(fold(b("It is  the A. B. Plevishka\nof J (x) twice in\n2008?\nRegistrar, R. Tom 12,300.50 \n\n next by X., and"))).tobytes()
    assert out == b"A is the A of I (x) twice in 0.\nA, A 0 next by I., and"
    assert len(fold(b(""))) == 0 and fold(b("a")).tobytes() == b"a"


def test_context_counts_are_exact():
    text = "abcab abc abcabcabcabcabcabcabc" * 3
    h = context_hashes(b(text))
    ctx = Contexts(np.array([0, 1, 3, 0]), np.array([h[0][5], h[1][20], h[3][60], 12345], np.uint64))
    n = ctx.count(b(text))
    want = [sum(text[: i + 1].endswith(text[p - k + 1 : p + 1]) for i in range(len(text))) for k, p in ((3, 5), (6, 20), (24, 60))]
    assert n.tolist() == [*want, 0]


def test_cut_texts_are_found(spark, ws):
    rng = random.Random(11)
    names = ["Tom", "Ann", "Eve", "Max"]
    say = lambda: rng.choice(["the clerk gave the keys to {}", "after {} days the buyer lost the case", "no one asked {} about the house", "the court sent the letter to {}"]).format(rng.choice([rng.choice(names), "12"])) + "."
    docs, want = [], set()
    for d in range(1200):
        t = " ".join(say() for _ in range(rng.randrange(20, 40)))
        end = rng.random()
        if d % 12 == 0:
            t = t[: rng.randrange(300, 500)].rstrip()
            while t[-1] in ". " or not t[-1].islower() or t.split()[-1][0].isupper():
                t = t[:-1]
            t += rng.choice(["", "", "…", " (...)", "\n- 12 -"])
            want.add(d)
        elif end < 0.3:
            t += "\nRegistrar, " + rng.choice(names)
        elif end < 0.5:
            t += "\n- 12 -"
        docs.append((d, t, rng.choice(["en", "EN"]), "clash"))
    docs += [(5000, None, "en", ""), (5001, " \n ", "en", ""), (5002, " ".join(say() for _ in range(20_000)), None, ""), (5003, docs[1][1], "en", ""), (5003, docs[1][1], "en", "")]
    out = truncated(spark.createDataFrame(docs, S), ws).collect()
    got = {r.doc_id for r in out if r.cut}
    assert 5000 not in {r.doc_id for r in out} and 5001 not in {r.doc_id for r in out}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)


def test_padded_texts_are_judged_by_their_end(spark, ws):
    rng = random.Random(13)
    say = lambda: f"the clerk gave the {rng.choice(['keys', 'book', 'letter'])} to the {rng.choice(['buyer', 'court', 'owner'])}."
    docs = [(d, " ".join(say() for _ in range(30)), "en", "") for d in range(400)]
    docs += [(1000, docs[0][1] + " " * 2000, "en", ""), (1001, docs[1][1] + " \n\t" * 500, "en", "")]
    cut = {r.doc_id: r.cut for r in truncated(spark.createDataFrame(docs, S), ws).collect()}
    assert not cut[1000] and not cut[1001]


def test_ends_are_read_as_far_as_closing_lines_reach():
    lines = ["So the court heard the case.", *[f"Line {'x' * 90} no" for _ in range(400)]]
    text = "\n".join(["One sentence. " * 50, *lines]) + " \n" * 3000
    (end, ends, _), (none, _, _) = tails_of(pa.array([text, ""], pa.string()))
    assert len(ends) == 400 and "the court heard the case." in end and none == ""
    assert judged_end(end, ends, frozenset(ends)).endswith("the court heard the case.")


def test_end_hashes_are_context_hashes():
    for t in ("Ab", "one two.\nthree four", "and so it was said at length by the clerk\nof the court", ""):
        v = soften(np.frombuffer(t.encode(), np.uint8))
        want = [int(h[-1]) if len(h) else 0 for h in context_hashes(v)]
        assert end_hashes([t])[0].tolist() == want


def test_the_valley_lies_between_two_heaps():
    counts = np.zeros(240)
    counts[60:70], counts[110:130] = 50, 900
    assert 0 <= valley(counts, -10.0, 0.125, (1.0, 16.0)) < 110 * 0.125 - 10


def test_languages_and_columns_have_their_own_model(spark, ws):
    """"von" ends texts of one language and goes on in the other; a wrong language falls back to what all have."""
    rng = random.Random(17)
    say = lambda w: " ".join(rng.choice(["abra", "belo", "casu", "dino", "ento"]) for _ in range(8)) + f" {w}. "
    docs = []
    for d in range(900):
        en = d % 3 > 0
        t = "".join(say("next" if en else "dann") + ("he came von his own " if en else "") for _ in range(15)).strip()
        docs.append((d, t if en else t + " Amen von", "en" if en else "de", t[: len(t) // 2 + 3] if d % 10 == 0 else t))
    docs += [(2000, docs[1][1][:-40] + " he came von", "en", ""), (2001, docs[2][1], "de", ""), (2002, docs[2][1], "xx", "")]
    out = truncated(spark.createDataFrame(docs, "doc_id long, text string, lang string, note string"), ws, columns=("text", "note"))
    cut = {(r.doc_id, r.column): r.cut for r in out.collect()}
    assert cut[2000, "text"] and not cut[2001, "text"] and not cut[2002, "text"]
    assert sum(cut[d, "text"] for d in range(900)) < 10
    notes = {d for d in range(900) if cut[d, "note"]}
    assert len(notes & set(range(0, 900, 10))) >= 0.9 * 90 and len(notes - set(range(0, 900, 10))) < 10


def test_empty(spark, ws):
    assert truncated(spark.createDataFrame([], S), ws).count() == 0
