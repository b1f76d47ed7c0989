import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from morsel.functions.text import UNIT
from morsel.operators import seeds, vocabulary
from morsel.operators.ranking import global_rank, rank_within, top
from morsel.operators.train import losses, train_vocab, usage
from morsel.scratch import Scratch

TEXTS = ["the cat sat on the mat\nthe end", "a cat and  the hat", "hat trick: the cat", "Привет мир, привет", "", None, "  \n", "été the cat"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def brute_units(text):
    import re

    out = []
    for line in text.split("\n"):
        for u in re.findall(UNIT, line.removesuffix("\r")):
            out.append(u[1:] if len(u) > 1 and u[0] == " " and u[1] != " " else u)
    return out


def brute_counts(texts, most):
    c = Counter()
    for t in texts:
        for u in brute_units(t or ""):
            for i in range(len(u)):
                for j in range(i + 1, len(u) + 1):
                    if len(u[i:j].encode()) <= most:
                        c[u[i:j]] += 1
    return c


def brute_usage(units, lp):
    total = Counter()
    for u, n in units.items():
        best = [(0, np.float32(0), 0)] + [None] * len(u)
        for i in range(len(u)):
            if best[i] is None:
                continue
            for j in range(i + 1, len(u) + 1):
                if u[i:j] in lp:
                    new = (best[i][0] + 1, best[i][1] - lp[u[i:j]], i)
                    if best[j] is None or new[:2] < best[j][:2]:
                        best[j] = new
        at = len(u)
        while at:
            if best[at] is None:
                at -= 1
                continue
            total[u[best[at][2] : at]] += n
            at = best[at][2]
    return total


def brute_train(texts, size, most, shrink, min_freq):
    texts = [t for t in texts if t and t.strip()]
    guaranteed = [chr(c) for a, b in (seeds.ASCII, *seeds.LETTERS, *seeds.SYMBOLS) for c in range(a, b + 1)]
    counts = {t: n for t, n in brute_counts(texts, most).items() if n >= min_freq or len(t) == 1}
    for t in guaranteed:
        counts.setdefault(t, 1)
    units = Counter(u for t in texts for u in brute_units(t))

    def rate(keys):
        total = sum(counts[t] for t in keys)
        return {t: np.float32(math.log(counts[t]) - math.log(total)) for t in keys}

    lp = rate(counts)
    single = [t for t in counts if len(t) == 1]
    multi = [t for t in counts if len(t) > 1]
    target = max(0, size - len(single) - 4)
    while len(multi) > target:
        used = brute_usage(units, lp)
        keep = max(target, int(len(multi) * shrink))
        multi = sorted(multi, key=lambda t: (-float(np.float64(used[t]) * -np.float64(lp[t])), t.encode()))[:keep]
        lp = rate(single + multi)
    lp.update(dict.fromkeys(seeds.SPECIALS, 0.0))
    return sorted(lp, key=lambda t: (-lp[t], t.encode()))


def test_seed_counts(spark):
    got = {r["token"]: r["cnt"] for r in seeds.seed_counts(docs(spark), 6, 1).collect()}
    assert got == dict(brute_counts(TEXTS, 6))
    two = {r["token"]: r["cnt"] for r in seeds.seed_counts(docs(spark), 6, 2).collect()}
    assert two == {t: n for t, n in got.items() if n > 1 or len(t) == 1}
    assert seeds.seed_counts(docs(spark, ["ab ab"]), 4, 1).filter("token in ('ab', 'a')").agg(F.sum("cnt")).first()[0] == 4


def test_long_units_go_in_stretches(spark):
    t = "".join(chr(97 + i * i % 26) for i in range(3000))
    got = {r["token"]: r["cnt"] for r in seeds.seed_counts(docs(spark, [t]), 5, 1).collect()}
    assert got == dict(brute_counts([t], 5))


def test_batches_drop_what_is_rare_in_each(spark):
    d = docs(spark, ["xy", "zz zz", "xy", "zz"])
    assert {r["token"] for r in seeds.seed_counts(d, 4, 2, batch=2).collect()} == {"x", "y", "z", "zz"}
    assert "xy" in {r["token"] for r in seeds.seed_counts(d, 4, 2).collect()}


def test_guaranteed(spark):
    assert seeds.guaranteed_tokens(spark).count() == 2832 and seeds.guaranteed_tokens(spark, False).count() == 1296
    got = {r["token"]: r["cnt"] for r in seeds.add_guaranteed(spark.createDataFrame([("a", 5)], "token string, cnt long")).collect()}
    assert got["a"] == 5 and got["\U0001f600"] == 1 and got["\0"] == 1 and len(got) == 2832


def test_log_probs(spark):
    got = {r["token"]: r["log_prob"] for r in seeds.log_probs(spark.createDataFrame([("a", 3), ("b", 1), ("c", 0)], "token string, cnt long")).collect()}
    assert got == {"a": pytest.approx(math.log(0.75)), "b": pytest.approx(math.log(0.25))}
    assert seeds.log_probs(spark.createDataFrame([("c", 0)], "token string, cnt long")).count() == 0


def test_usage_and_losses(spark):
    lp = {"c": -4.0, "a": -4.0, "t": -4.0, "ca": -3.0, "at": -2.5, "cat": -5.0}
    tokens = spark.createDataFrame(list(lp.items()), "token string, log_prob float")
    units = Counter({"cat": 3, "cata": 2, "xcat": 1, "": 1})
    pieces = spark.createDataFrame(list(units.items()), "unit string, n long")
    got = {r["token"]: r["usage"] for r in usage(pieces, tokens).collect()}
    assert got == {t: n for t, n in brute_usage(units, {t: np.float32(p) for t, p in lp.items()}).items() if t}
    multi = tokens.filter("length(token) > 1").withColumn("cnt", F.lit(2).cast("long"))
    assert {r["token"]: r["loss"] for r in losses(multi, tokens, None).collect()} == {"ca": 6.0, "at": 5.0, "cat": 10.0}
    assert {r["token"]: r["loss"] for r in losses(multi, tokens, pieces).collect()}["ca"] == 0


def test_training_against_plain_python(spark):
    want = brute_train(TEXTS, 2832 + 4 + 12, 8, 0.5, 2)
    got = train_vocab(docs(spark), 2832 + 4 + 12, 8, 0.5, 2).orderBy("token_id").collect()
    assert [bytes(r["token"]).decode() for r in got] == want and [r["token_id"] for r in got] == list(range(len(got)))
    assert [bytes(r["token"]) for r in got[:4]] == [b"</s>", b"<pad>", b"<s>", b"<unk>"]
    with pytest.raises(ValueError):
        train_vocab(docs(spark), 10, shrink=1.0)


def test_small_targets_and_empty_corpora(spark):
    got = train_vocab(docs(spark), 1, 8, 0.5, 2, special_order="declared").orderBy("token_id").collect()
    assert len(got) == 2832 + 4 and [bytes(r["token"]).decode() for r in got[:4]] == list(seeds.SPECIALS)
    assert train_vocab(docs(spark, [None, " "]), 5000, 8).count() == 2836


def test_vocabulary_tables(spark):
    v = spark.createDataFrame([(0, bytearray(b"a"), -1.0), (1, bytearray(b"bc"), -2.0), (2, bytearray(b"a"), -3.0)], "token_id int, token binary, log_prob float")
    assert sorted((bytes(r[0]), r[1], r[2]) for r in vocabulary.insertion_lookup(v).collect()) == [(b"a", 2, -3.0), (b"bc", 1, -2.0)]
    assert sorted(r["token_id"] for r in vocabulary.without_repeats(v).collect()) == [0, 1]
    s = vocabulary.statistics(v).first()
    assert s["size"] == 3 and s["multi_byte"] == 1 and s["mean_bytes"] == pytest.approx(4 / 3)
    assert vocabulary.missing_ascii(v).count() == 94
    got = {r["t"]: (r["token_id"], r["log_prob"]) for r in vocabulary.look_up(spark.createDataFrame([("a",), ("x",)], "t string"), v, "t").collect()}
    assert got == {"a": (2, -3.0), "x": (None, float("-inf"))}
    x, y = (spark.createDataFrame(r, "token string, p int") for r in ([("a", 1), ("b", 1)], [("b", 2), ("c", 2)]))
    assert sorted(map(tuple, vocabulary.first_wins(x, y).collect())) == [("a", 1), ("b", 1), ("c", 2)]
    assert sorted(map(tuple, vocabulary.later_wins(x, y).collect())) == [("a", 1), ("b", 2), ("c", 2)]


def test_ranks(spark):
    rows = [(i * 7919 % 503, None if i % 5 == 0 else i % 3) for i in range(503)]
    df = spark.createDataFrame(rows, "x int, g int")
    s = Scratch(spark, "t")
    assert {r["x"]: r["rank"] for r in global_rank(df, [F.desc("x")], s).collect()} == {x: 502 - x for x in range(503)}
    assert sorted(r["x"] for r in top(df, [F.asc("x")], 5, s).collect()) == list(range(5))
    want = {}
    for g in (None, 0, 1, 2):
        want.update({x: k for k, x in enumerate(sorted(x for x, h in rows if h == g))})
    assert {r["x"]: r["rank"] for r in rank_within(df, "g", [F.asc("x")], s).collect()} == want
    assert global_rank(df.limit(0), [F.asc("x")], s).count() == 0


def test_tokens_longer_than_any_constant_are_used(spark):
    word = "x" * 20 + "y" * 20
    lp = {"x": -9.0, "y": -9.0, word: -1.0}
    tokens = spark.createDataFrame(list(lp.items()), "token string, log_prob float")
    got = {r["token"]: r["usage"] for r in usage(spark.createDataFrame([(word, 3), ("z" + word, 2), (word + "z", 1)], "unit string, n long"), tokens).collect()}
    assert got == {word: 4}


def test_seed_counts_of_large_batches(spark, monkeypatch):
    """Batches of one task, and those that are taken apart by what substrings begin with, against plain Python; nulls are a batch."""
    texts = ["ab abc\r\nabcd  x", "xabc é日é", "é日é ab", " ", "abcd", "zz zz", None, "ab abcde"]
    rows = [(k if k != 5 else None, t) for k, t in enumerate(texts)]
    want = Counter()
    for batch in ([0, 1, 2], [3, 4], [6, 7], [5]):
        got = brute_counts([texts[k] for k in batch], 5)
        want.update({t: n for t, n in got.items() if n >= 2 or len(t) == 1})
    d = spark.createDataFrame(rows, "doc_id int, text string")
    for most in (4096, 1):
        monkeypatch.setattr(seeds, "ONE_TASK", most)
        assert {r["token"]: r["cnt"] for r in seeds.seed_counts(d, 5, 2, batch=3).collect()} == want


def test_seed_counts_drop_what_is_rare_with_its_longer_forms():
    data = np.frombuffer("abcabdéx".encode(), np.uint8)
    got = {data[p : p + k].tobytes().decode(): n for at, k, c in seeds.prefix_counts(data, np.array([0, 3, 6]), np.array([3, 6, 9]), np.array([1, 2, 1]), 3) for p, n in zip(at.tolist(), c.tolist())}
    assert got == {"a": 3, "ab": 3, "é": 1}


def test_usage_of_more_tokens_than_workers_hold(spark, monkeypatch):
    """The same usage from tables, with few places a group, pieces that no path spans, long ones and characters of many bytes."""
    from morsel.operators import train

    monkeypatch.setattr(train, "PLACES", 7)
    units = Counter({"abcab": 2, "abc": 1, "xyabq": 3, "日本é": 2, "qqq": 1, "ab" * 40: 5, "é": 1, "éa日": 4})
    lp = {"a": -2.0, "b": -2.5, "c": -3.0, "ab": -4.0, "bc": -3.5, "abc": -6.0, "x": -5.0, "y": -5.0, "日": -6.0, "本": -7.0, "日本": -9.0, "é": -4.0, "éa": -8.0, "bab": -9.5}
    pieces = spark.createDataFrame(list(units.items()), "unit string, n long")
    tokens = spark.createDataFrame(list(lp.items()), "token string, log_prob float")
    got = {r["token"]: r["usage"] for r in train.usage(pieces, tokens, most=3).collect()}
    assert got == {r["token"]: r["usage"] for r in train.usage(pieces, tokens).collect()}
    assert got == {t: n for t, n in brute_usage(units, {t: np.float32(p) for t, p in lp.items()}).items() if t}


def test_rank_within_brings_no_group_together(spark, request):
    """Groups that span ranges, a null one, and a plan in which no rows are hashed by their group alone."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    rows = [("en" if k % 5 else None if k % 2 else "de", k) for k in range(1000)]
    df = spark.createDataFrame(rows, "g string, x long").repartition(5)
    out = rank_within(df, "g", [F.asc("x")], Scratch(spark, "within"))
    seen, want = Counter(), {}
    for g, k in rows:
        want[k], seen[g] = seen[g], seen[g] + 1
    assert {r["x"]: r["rank"] for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_rounds_by_counts_at_once(spark, monkeypatch):
    """The vocabulary of rounds one by one, with fewer tables; and the fewest rows that a count can rank."""
    from morsel.operators import train

    d = docs(spark, TEXTS * 3 + ["abcdefgh ijklmnop " * 3, "abcdeh ijknop qrs" * 2])
    made = lambda: {(bytes(r["token"]), r["token_id"], r["log_prob"]) for r in train_vocab(d, vocab_size=1340, max_bytes=8, symbols=False, usage_most=0).collect()}
    spied = []
    whole = train._count_rounds
    monkeypatch.setattr(train, "_count_rounds", lambda *a: spied.append(whole(*a)) or spied[-1])
    at_once = made()
    assert spied[0][0] is not None
    monkeypatch.setattr(train, "_count_rounds", lambda *a: (None, a[1]))
    assert at_once == made()
