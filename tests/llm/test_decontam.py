import random

from hypothesis import given, settings
from hypothesis import strategies as st

from morsel.llm.decontam import Matcher, Myers, contaminated, drop_contaminated, normalize, pieces


def nearest(p, t):
    """Least edit distance of p to any stretch of t, by the textbook table."""
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        new = [0]
        for i, x in enumerate(p, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (x != c)))
        row = new
        best = min(best, row[-1])
    return best


@settings(max_examples=300, deadline=None)
@given(st.text("ab c", min_size=1, max_size=90), st.text("ab c", max_size=120))
def test_myers(p, t):
    assert Myers(p).best(t)[0] == nearest(p, t)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abé ", max_size=40), max_size=4), st.text("abé ", max_size=150), st.sampled_from([0.0, 0.05, 0.1, 0.25]))
def test_finds_exactly_what_brute_force_finds(items, text, rate):
    items = list(enumerate(items))
    want = []
    for i, t in items:
        n = normalize(t)
        if n and (d := nearest(n, normalize(text))) <= min(int(rate * len(n) + 1e-9), len(n) - 1):
            want.append((i, d))
    assert sorted(Matcher(items, rate).find(text)) == want


def test_pieces():
    assert pieces("a" * 100, 0.05) and [len(p) for _, p in pieces("a" * 100, 0.05)] == [16, 17, 17, 16, 17, 17]
    assert "".join(p for _, p in pieces("hello world", 0.3)) == "hello world" and len(pieces("x", 1.0)) == 1


def test_documents(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    item = " ".join(word() for _ in range(30))
    other = " ".join(word() for _ in range(20))
    pad = lambda n: " ".join(word() for _ in range(n))
    edited = item[:40] + "zz" + item[42:90] + item[92:]
    rows = [(1, pad(50) + " " + item + " " + pad(9)), (2, item.upper().replace(" ", "\n ")), (3, pad(30) + edited + pad(5)), (4, pad(200)), (5, None), (6, ""), (7, other + " " + item), (7, other + " " + item), (None, item), (8, pad(200000) + " " + item)]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(10, item), (11, other), (12, item), (13, None), (14, " ")], "item_id long, text string")
    want = sorted(map(str, [(d, i, e) for d, e in ((1, 0), (2, 0), (3, 4), (7, 0), (7, 0), (None, 0), (8, 0)) for i in (10, 12)] + [(7, 11, 0)] * 2))
    for most in (1 << 20, 50):
        got = contaminated(docs, bench, most=most)
        assert sorted(str((r.doc_id, r.item_id, r.distance)) for r in got.collect()) == want
        assert sorted(str(r.doc_id) for r in drop_contaminated(docs, bench, most=most).collect()) == ["4", "5", "6"]
    assert drop_contaminated(docs, bench).columns == docs.columns
    assert contaminated(docs, bench.limit(0)).count() == 0 and contaminated(docs.limit(0), bench).count() == 0
    assert drop_contaminated(docs, bench.limit(0)).count() == len(rows)


def test_ids_that_are_no_numbers(spark):
    item = "a passage of the benchmark that is long enough to be found"
    docs = spark.createDataFrame([("d1", "x " + item), ("2", item)], "doc_id string, text string")
    bench = spark.createDataFrame([("b", item)], "item_id string, text string")
    assert sorted(str((r.doc_id, r.item_id)) for r in contaminated(docs, bench).collect()) == ["(2, None)", "(None, None)"]
