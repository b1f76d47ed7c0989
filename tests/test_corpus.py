import gzip
import json

import pytest
from pyspark.sql import functions as F

from morsel.operators import interleave, metrics
from morsel.operators.segment import encode
from morsel.sources import corpus, reports
from morsel.streaming import encode as streams
from morsel.tokenizer import Tokenizer

CONFIG = """# blend
mix_ratios:
  en: 2.0   # twice
  de: 0.5
sources:
  - path: a.txt
    language: en
  - path: "b.jsonl.gz"
    language: fr
    reader: jsonl_gz
    text_field: content
"""


def tokenizer():
    return Tokenizer([(i, bytes([i]), -5.0) for i in range(256)] + [(256, b"ab", -1.0)])


def test_config(tmp_path, spark):
    (tmp_path / "c.yaml").write_text(CONFIG)
    want = [corpus.Source("/x/a.txt", "en", 2.0), corpus.Source("/x/b.jsonl.gz", "fr", 1.0, "jsonl_gz", "content")]
    assert corpus.load_config(str(tmp_path / "c.yaml"), "/x") == want
    assert corpus._parse_plain(CONFIG)["sources"] == [{"path": "a.txt", "language": "en"}, {"path": "b.jsonl.gz", "language": "fr", "reader": "jsonl_gz", "text_field": "content"}]
    assert corpus.config_table(spark, want).filter("weight = 2").count() == 1


def test_readers(tmp_path, spark):
    text = "one\ntwo\r\n \t\n\n  three \nfour\n\n\n"
    (tmp_path / "a.txt").write_bytes(text.encode())
    with gzip.open(tmp_path / "a.txt.gz", "wt") as f:
        f.write("x\n\ny")
    lines = ['{"text": "a"}', "", "broken {", '{"text": ""}', '{"other": "b"}', '{"text": 5}', '{"text": null}', ' {"text": "é\\n2", "k": {"text": "no"}} ']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    S = corpus.Source
    read = lambda s: [r["text"] for r in corpus.read_source(spark, s).orderBy("idx").collect()]
    assert read(S(str(tmp_path / "a.txt"))) == ["one\ntwo", "  three \nfour"]
    assert read(S(str(tmp_path / "a.txt.gz"), reader="text_gz")) == ["x", "y"]
    assert read(S(str(tmp_path / "a.jsonl"), reader="jsonl")) == ["a", "é\n2"]
    assert [r["text"] for r in corpus.read_jsonl(spark, str(tmp_path / "a.jsonl"), strings_only=False).orderBy("idx").collect()] == ["a", "5", "é\n2"]
    with pytest.warns(UserWarning):
        assert read(S(str(tmp_path / "none"))) == []
    with pytest.raises(ValueError):
        read(S(str(tmp_path / "a.txt"), reader="csv"))
    both = [S(str(tmp_path / "a.txt"), weight=1.0), S(str(tmp_path / "a.jsonl"), "de", 1.0, "jsonl")]
    assert corpus.estimate_size(spark, [*both, S("/none/at/all")]) == sum((tmp_path / n).stat().st_size for n in ("a.txt", "a.jsonl"))
    assert [r["text"] for r in corpus.collect_documents(spark, both).orderBy("ord").collect()] == ["a", "one\ntwo", "é\n2", "  three \nfour"]
    assert corpus.collect_documents(spark, both, 2).count() == 2
    assert corpus.read_sources(spark, []).count() == 0


def test_filtered_sink_and_cases(tmp_path, spark):
    df = spark.createDataFrame([(1, "  long enough  "), (2, "short"), (3, None), (4, "also long enough")], "doc_id int, text string")
    corpus.write_filtered(df, f"{tmp_path}/out", 10, 1)
    assert [json.loads(x)["text"] for p in (tmp_path / "out").glob("*.gz") for x in gzip.open(p, "rt")] == ["long enough"]
    (tmp_path / "cases.json").write_text(json.dumps(["", "a\nb", "é"]))
    assert [tuple(r) for r in corpus.read_cases(spark, f"{tmp_path}/cases.json").collect()] == [(0, ""), (1, "a\nb"), (2, "é")]


def test_schedules():
    assert interleave.credit_schedule([2, 2], [1, 1]) == [1, 0, 1, 0]
    assert interleave.credit_schedule([1, 4], [3, 1]) == [0, 1, 1, 1, 1] and interleave.credit_schedule([3, 3], [1, 1], 2) == [1, 0]
    assert interleave.credit_schedule([], []) == [] and interleave.credit_schedule([0, 2], [5, 1]) == [1, 1]
    a = interleave.random_schedule([50, 50], [3.0, 1.0])
    assert a == interleave.random_schedule([50, 50], [3.0, 1.0]) and sorted(a) == [0] * 50 + [1] * 50 and a[:40].count(0) > 22


@pytest.mark.parametrize("method", ["spread", "credit", "random"])
def test_interleave(spark, method):
    rows = [(i, "ab"[i % 2], " " if i == 3 else f"t{i}") for i in range(20)] + [(99, "c", "left out")]
    df = spark.createDataFrame(rows, "doc_id int, source string, text string")
    got = interleave.interleave(df, [("a", 3.0), ("b", 1.0)], method=method).orderBy("ord").collect()
    assert [r["ord"] for r in got] == list(range(19)) and {r["doc_id"] for r in got} == set(range(20)) - {3}
    for s in "ab":
        ids = [r["doc_id"] for r in got if r["source"] == s]
        assert ids == sorted(ids)
    assert sum(r["source"] == "a" for r in got[:10]) >= 6
    assert interleave.interleave(df, [("a", 1.0)], method=method, max_docs=4).count() == 4


def test_metrics_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("en", "ab ab"), ("en", None), ("ru", "éé"), ("xx", "")], "lang string, text string")
    m = metrics.compression(encode(df, tokenizer().segmenter))
    got = {r["lang"]: r.asDict() for r in m.collect()}
    assert got["en"]["tokens"] == 2 and got["en"]["chars"] == 5 and got["en"]["chars_per_token"] == 2.5
    assert got["xx"]["chars_per_token"] == 0 and got["ru"]["bytes_per_token"] == 1.0
    p = {r["lang"]: r for r in metrics.parity(m.filter("lang <> 'xx'"), "en").collect()}
    assert p["en"]["verdict"] == "good" and p["ru"]["raw_ratio"] == 2.0 and p["ru"]["char_ratio"] == 5.0 and p["ru"]["verdict"] == "poor"
    x = metrics.improvement(m, "lang", "en", "ru", "chars_per_token").first()
    assert x["percent"] == pytest.approx(400.0) and x["times"] == pytest.approx(5.0)
    d = spark.createDataFrame([("a", "a"), ("b", "<unk>"), ("c", None), ("d", "x"), (None, None)], "text string, decoded string")
    assert {r["status"]: r["n"] for r in metrics.round_trip(d).collect()} == {"lossless": 2, "unknown": 1, "error": 1, "broken": 1}
    assert metrics.throughput(lambda: None, 10**6, 2)["best_mb"] > 0
    small = spark.createDataFrame([("a", 1.5, None)], "k string, v double, n int")
    assert reports.markdown(small) == "| k | v | n |\n| --- | --- | --- |\n| a | 1.500 |  |" and "1.500" in reports.console(small)
    reports.write_json(small, f"{tmp_path}/r.json")
    assert json.load(open(f"{tmp_path}/r.json")) == [{"k": "a", "v": 1.5, "n": None}]


def test_streams(spark, tmp_path):
    t = tokenizer()
    src = spark.createDataFrame([("ab ab", 0), ("x", 30), (None, 90)], "text string, s long").select("text", F.timestamp_seconds("s").alias("ts"))
    src.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    q = streams.write(streams.encode_stream(stream(), t.segmenter), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert q.awaitTermination(120)
    assert sorted((r["text"] or "", r["ids"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("", None), ("ab ab", t.encode("ab ab")), ("x", t.encode("x"))]
    q = streams.token_rates(stream(), t.segmenter, "ts").writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert [(r["n_texts"], r["tokens"]) for r in spark.sql("select * from rates order by window.start").collect()] == [(2, 3), (1, None)]


def test_paragraphs_over_many_splits(tmp_path, spark):
    """Splits of a few bytes: paragraphs that reach over several of them come back whole and in order."""
    rng = __import__("random").Random(3)
    lines = [rng.choice(["", " \t", "\u3000\u00a0", "word", "two words", "é" * 9, "x" * 40]) for _ in range(400)]
    want, run = [], []
    for x in [*lines, ""]:
        if x.strip():
            run.append(x)
        elif run:
            want.append("\n".join(run))
            run = []
    (tmp_path / "t.txt").write_bytes("\n".join(x + ("\r" if k % 3 else "") for k, x in enumerate(lines)).encode())
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("64", "700", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = corpus.read_text(spark, str(tmp_path / "t.txt")).orderBy("idx").collect()
            assert [r["text"] for r in got] == want and [r["idx"] for r in got] == list(range(len(want)))
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_field_names_and_package(tmp_path, spark):
    (tmp_path / "q.jsonl").write_text(json.dumps({"it's": "a", 'say "b"': "c"}))
    assert [r["text"] for r in corpus.read_jsonl(spark, str(tmp_path / "q.jsonl"), "it's").collect()] == ["a"]
    assert [r["text"] for r in corpus.read_jsonl(spark, str(tmp_path / "q.jsonl"), 'say "b"').collect()] == ["c"]
    with pytest.raises(ValueError):
        corpus.read_jsonl(spark, "x", "both ' and \"")
    import morsel

    assert all(getattr(morsel, n) is not None for n in morsel.__all__) and morsel.Tokenizer is Tokenizer
    with pytest.raises(AttributeError):
        morsel.nothing


def test_chunks_at_units_change_no_ids():
    """Texts cut at unit borders, in chunks of some bytes, give the same ids as whole."""
    t = tokenizer()
    text = "ab  cd e   ab ab\n  x " * 50
    from morsel.operators.segment import cut_units, joined

    data, off = joined([text.encode()])
    at = cut_units(data, off).tolist()
    for least in (1, 7, 256):
        cuts, parts = [0], []
        for p in at[1:]:
            if p - cuts[-1] >= least or p == at[-1]:
                parts.append(data[cuts[-1] : p].tobytes().decode())
                cuts.append(p)
        assert "".join(parts) == text and [i for p in parts for i in t.encode(p)] == t.encode(text)
