import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from morsel.llm import suffix_dedup as S


def brute(rows, size):
    """Merged spans of windows that stand at two places, and the least document of each."""
    at = defaultdict(list)
    for k, (d, t) in enumerate(rows):
        if t is not None and d is not None:
            w = t.split()
            for i in range(len(w) - size + 1):
                at[tuple(w[i : i + size])].append((k, d, i))
    hit = defaultdict(dict)
    for places in at.values():
        if len(places) > 1:
            for k, d, i in places:
                hit[d][i] = min(hit[d].get(i, d), *(p[1] for p in places))
    out = []
    for d, starts in hit.items():
        a = b = None
        for i in sorted(starts):
            if a is None or i > b:
                if a is not None:
                    out.append((d, a, b, low))
                a, low = i, starts[i]
            b, low = i + size, min(low, starts[i])
        out.append((d, a, b, low))
    return sorted(out)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda k: " ".join(rng.choices(vocab, k=k))
    passages = [text(rng.randint(6, 40)) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [text(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages).split()
            cut = rng.randint(0, 5)
            parts += [" ".join(p[cut:]), text(rng.randint(0, 30))]
        rows.append((i, "\n ".join(parts)))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1] + " tail"), (n + 2, "aa bb " * 40), (n + 3, "aa bb " * 17 + text(9)), (n + 4, rows[5][1])]
    return rows


@pytest.mark.parametrize("seed,size,gram", [(1, 8, 3), (2, 12, 4), (3, 10, 10)])
def test_against_brute_force(spark, seed, size, gram):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, S.repeated_passages(df, size, gram).collect()))
    assert got == brute(rows, size)


def test_hot_anchors_are_counted_by_windows(spark):
    """A phrase shorter than a window in ever new surroundings: the same result, whatever a task may hold."""
    rng = random.Random(9)
    phrase = " ".join(f"p{i}" for i in range(7))
    text = lambda k: " ".join(f"v{rng.randrange(30000)}" for _ in range(k))
    rows = corpus(5) + [(200 + i, f"{text(15)} {phrase} {text(15)}") for i in range(60)]
    rows += [(300, rows[70][1]), (301, rows[71][1] + " tail"), (301, rows[71][1] + " tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 10)
    for hot in (0, 5, S.HOT):
        assert sorted(map(tuple, S.repeated_passages(df, 10, 4, hot=hot).collect())) == want


def test_runs_hold_every_window_once():
    text = [t for _, t in corpus(4)] + ["", "short"]
    h, first = S.word_hashes(pa.array(text))
    doc, pos, count, anchor, content = S.runs(h, first, 9, 4)
    seen = {(d, p + i) for d, p, c in zip(doc.tolist(), pos.tolist(), count.tolist()) for i in range(c)}
    assert len(seen) == count.sum() and seen == {(k, i) for k, t in enumerate(text) for i in range(len(t.split()) - 8)}
    by = defaultdict(set)
    for d, p, c, a in zip(doc.tolist(), pos.tolist(), count.tolist(), anchor.tolist()):
        for i in range(c):
            by[tuple(text[d].split()[p + i : p + i + 9])].add(a)
    assert all(len(v) == 1 for v in by.values())


def test_texts_that_repeat_themselves(spark):
    line = " ".join(f"q{i}" for i in range(30))
    rows = [(1, f"x {line} {line} {line} y"), (2, "aa bb " * 33), (3, " ".join(f"z{i}" for i in range(90))), (4, "cc " * 51), (5, "dd " * 50)]
    got = sorted(map(tuple, S.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows, S.MIN_WORDS) == [(1, 1, 91, 1), (2, 0, 66, 2), (4, 0, 51, 4)]


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 99, 200)
    for w in (1, 2, 3, 7, 8, 35, 200):
        assert S.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(len(x) - w + 1)]


def test_cases(spark):
    long = " ".join(f"x{i % 977}y{i % 31}" for i in range(120000))
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(1, "a " + p), (2, p + " z"), (3, None), (4, ""), (None, p), (5, long), (6, long), (7, p[:150]), (8, "q " + p + " r " + p), (9, "m n"), (9, "k " + p)]
    df = spark.createDataFrame([(a, b, 5) for a, b in rows], "doc_id long, text string, anchor int")
    got = sorted(map(tuple, S.repeated_passages(df).collect()))
    assert got == [(1, 1, 61, 1), (2, 0, 60, 1), (5, 0, 120000, 5), (6, 0, 120000, 5), (8, 1, 61, 1), (8, 62, 122, 1), (9, 1, 61, 1)]
    assert S.repeated_passages(df.limit(0)).count() == 0
