"""Queries over the given tables, each with the same question in DuckDB SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morsel.functions import text as T
from morsel.operators import decode, interleave, metrics, seeds, segment, vocabulary
from morsel.operators.ranking import top_by_count
from morsel.operators.train import train_vocab
from morsel.scratch import Scratch
from morsel.sources.corpus import filtered
from morsel.sources.files import stamp

#: The vocabulary of the queries, of the command line's size and longest token: guaranteed and single characters, and the most frequent longer ones.
LONGER, MAX_BYTES, MIN_FREQ, SHRINK = 262_144 - 2_836, 32, 2, 0.75

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_UNITS = f"regexp_extract_all(text, '{T.UNIT}')"
_SEED_UNITS = f"""seed_units AS (SELECT doc_id, CASE WHEN regexp_matches(u, '^ [^ ]') THEN u[2:] ELSE u END AS unit FROM (
    SELECT doc_id, unnest(regexp_extract_all(regexp_replace(line, '\\r$', ''), '{T.UNIT}')) AS u FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)))"""


def _spans(most: int, keys: str = "") -> str:
    """Substrings of seed units with their counts."""
    return f"""{_SEED_UNITS}, u AS (SELECT {keys} unit, count(*) AS n FROM seed_units GROUP BY ALL),
    s AS (SELECT {keys} n, unit[i:i + {most} - 1] AS tail FROM (SELECT {keys} n, unit, unnest(range(1, length(unit) + 1)) AS i FROM u)),
    t AS (SELECT {keys} n, tail[1:k] AS token FROM (SELECT {keys} n, tail, unnest(range(1, length(tail) + 1)) AS k FROM s) WHERE strlen(tail[1:k]) <= {most})"""


def _guaranteed() -> str:
    return "SELECT chr(c::INT) AS token FROM (" + " UNION ALL ".join(f"SELECT unnest(range({a}, {b + 1})) AS c" for a, b in (seeds.ASCII, *seeds.LETTERS, *seeds.SYMBOLS)) + ")"


_COUNTS = f"""{_spans(MAX_BYTES)}, seed AS (SELECT token, sum(n)::BIGINT AS cnt FROM t GROUP BY token HAVING sum(n) >= {MIN_FREQ} OR length(token) = 1),
    counts AS (SELECT * FROM seed UNION ALL SELECT token, 1 FROM ({_guaranteed()}) WHERE token NOT IN (SELECT token FROM seed)),
    pruned AS (SELECT * FROM counts WHERE cnt >= {MIN_FREQ} OR length(token) = 1)"""
_VOCAB = f"""{_COUNTS}, chosen AS (SELECT * FROM pruned WHERE length(token) = 1 UNION ALL (SELECT * FROM pruned WHERE length(token) > 1 ORDER BY cnt DESC, token LIMIT {LONGER})),
    rated AS (SELECT token, cnt, (ln(cnt) - ln((SELECT sum(cnt) FROM chosen)))::FLOAT AS log_prob FROM chosen),
    ready AS (SELECT token, 9223372036854775807 AS cnt, 0::FLOAT AS log_prob FROM (VALUES ('<unk>'), ('<s>'), ('</s>'), ('<pad>')) v(token) UNION ALL SELECT token, cnt, log_prob FROM rated),
    vocab AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY log_prob DESC, token) - 1)::INT AS token_id, token, log_prob FROM ready)"""


def _encoded(source: str = "documents", key: str = "doc_id") -> str:
    """The vocabulary, units of a table, and `enc`: the ids of each distinct unit."""
    return f"""WITH RECURSIVE {_VOCAB},
    placed AS MATERIALIZED (SELECT {key} AS k, unnest({_UNITS}) AS unit, generate_subscripts({_UNITS}, 1) AS pos FROM {source}),
    du AS MATERIALIZED (SELECT DISTINCT unit FROM placed),
    places AS (SELECT unit, i, CASE WHEN unit[i + 1] = ' ' AND i + 1 < length(unit) THEN 1 ELSE 0 END AS sp FROM (SELECT unit, unnest(range(0, length(unit))) AS i FROM du)),
    fit AS (SELECT unit, i, sp, e FROM (SELECT unit, i, sp, unnest(range(i + sp + 1, least(length(unit), i + sp + {MAX_BYTES}) + 1)) AS e FROM places)),
    edges AS MATERIALIZED (SELECT unit, i AS s, e, CASE WHEN sp = 1 THEN token_id | {T.FLAG} ELSE token_id END AS id, log_prob AS lp FROM fit JOIN vocab ON vocab.token = unit[i + sp + 1:e]
        UNION ALL SELECT unit, i, i + 1, token_id, log_prob FROM places JOIN vocab ON vocab.token = ' ' WHERE sp = 1),
    walk(unit, n, pos, nlp, ids, done) AS (SELECT unit, length(unit), 0::BIGINT, 0::FLOAT, []::INT[], false FROM du
        UNION ALL SELECT unit, n, pos, nlp, ids, bool_or(pos = n) OVER (PARTITION BY unit) FROM (
            SELECT w.unit, w.n, e.e::BIGINT AS pos, (w.nlp - e.lp)::FLOAT AS nlp, list_append(w.ids, e.id) AS ids,
                row_number() OVER (PARTITION BY w.unit, e.e ORDER BY (w.nlp - e.lp)::FLOAT, w.pos) AS r
            FROM walk w JOIN edges e ON w.unit = e.unit AND w.pos = e.s WHERE NOT w.done) WHERE r = 1),
    best AS (SELECT unit, ids FROM walk WHERE pos = n),
    enc AS MATERIALIZED (SELECT unit, coalesce(ids, [(SELECT token_id FROM vocab WHERE token = '<unk>')]) AS ids FROM du LEFT JOIN best USING (unit)),
    whole AS MATERIALIZED (SELECT k, flatten(list(ids ORDER BY pos)) AS ids FROM placed JOIN enc USING (unit) GROUP BY k)"""


_VOCABS: dict[tuple, DataFrame] = {}


def _with_guaranteed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # counts are read twice, for themselves and for the guaranteed tokens that they lack
    return seeds.add_guaranteed(Scratch(spark, "counts").write(seeds.seed_counts(_table(spark, sf_dir), MAX_BYTES, MIN_FREQ), "seed"))


def counts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over a written table, so they can be read more than once."""
    return seeds.frequent(_with_guaranteed(spark, sf_dir), MIN_FREQ)


def vocab_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of a folder of tables: a written table, made once a session while the table stays as it is."""
    key = (spark.sparkContext.applicationId, sf_dir, *stamp(spark, f"{sf_dir}/documents.parquet"))
    if key not in _VOCABS:
        s = Scratch(spark, "vocab")
        pruned = counts_of(spark, sf_dir)
        longer = top_by_count(pruned.filter(F.char_length("token") > 1), "cnt", [F.asc("token")], LONGER, s)
        chosen = s.write(pruned.filter(F.char_length("token") == 1).unionByName(longer), "chosen")
        known = vocabulary.first_wins(seeds.special_tokens(spark), seeds.log_probs(chosen).select("token", "log_prob"))
        _VOCABS[key] = s.write(vocabulary.assign_ids(known, s), "vocab")
    return _VOCABS[key]


_HELD: dict[int, tuple[DataFrame, Broadcast, list[bytes | None]]] = {}


def _held(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Broadcast, list[bytes | None]]:
    v = vocab_of(spark, sf_dir)
    if id(v) not in _HELD:
        _HELD[id(v)] = v, spark.sparkContext.broadcast(segment.collect_segmenter(v)), decode.token_list(v)
    return _HELD[id(v)]


def segmenter_of(spark: SparkSession, sf_dir: str) -> Broadcast:
    """The vocabulary of a folder of tables as workers hold it, sent to them once a session."""
    return _held(spark, sf_dir)[1]


def tokens_of(spark: SparkSession, sf_dir: str) -> list[bytes | None]:
    return _held(spark, sf_dir)[2]


def encoded(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return segment.encode(_table(spark, sf_dir, name), segmenter_of(spark, sf_dir))


def _joined(ids: str = "ids"):
    return F.array_join(F.col(ids).cast("array<string>"), " ")


_P1 = "replace(text, '. ', '.' || chr(13) || chr(10)) || chr(10) || chr(10) || chr(10) || chr(10) || 'e' || chr(769) || chr(8203) || chr(13)"


@query(f"""SELECT doc_id, nfc_normalize(regexp_replace(regexp_replace(regexp_replace({_P1}, '[\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{FEFF}}\\x{{00AD}}]', '', 'g'), '\\r\\n?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')) AS text FROM documents""")
def normalize_docs(spark, sf_dir):
    rough = F.concat(F.replace("text", F.lit(". "), F.lit(".\r\n")), F.lit("\n\n\n\ne\u0301\u200b\r"))
    return _table(spark, sf_dir).select("doc_id", T.normalize(rough).alias("text"))


@query(f"SELECT doc_id, (generate_subscripts({_UNITS}, 1) - 1)::INT AS pos, unnest({_UNITS}) AS unit FROM documents")
def unit_split(spark, sf_dir):
    return _table(spark, sf_dir).select("doc_id", F.posexplode(T.units(F.col("text"))).alias("pos", "unit"))


@query(f"SELECT unit, count(*) AS n FROM (SELECT unnest({_UNITS}) AS unit FROM documents) GROUP BY unit")
def unit_freq(spark, sf_dir):
    return _table(spark, sf_dir).select(F.explode(T.units(F.col("text"))).alias("unit")).groupBy("unit").agg(F.count("*").alias("n"))


@query(f"SELECT unit, count(*) AS n FROM (SELECT unnest({_UNITS}) AS unit FROM (SELECT '  ' || replace(text, ' the ', '    the ') || ' ' AS text FROM documents)) GROUP BY unit")
def indent_units(spark, sf_dir):
    d = _table(spark, sf_dir).select(F.concat(F.lit("  "), F.replace("text", F.lit(" the "), F.lit("    the ")), F.lit(" ")).alias("text"))
    return d.select(F.explode(T.units(F.col("text"))).alias("unit")).groupBy("unit").agg(F.count("*").alias("n"))


@query("SELECT unit, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+')) AS unit FROM documents) GROUP BY unit")
def byte_words(spark, sf_dir):
    return seeds.unit_counts(_table(spark, sf_dir), True)


@query(f"WITH {_spans(32)} SELECT token, sum(n)::BIGINT AS cnt FROM t GROUP BY token HAVING sum(n) >= 2 OR length(token) = 1")
def seed_counts(spark, sf_dir):
    return seeds.seed_counts(_table(spark, sf_dir), 32, 2)


@query(f"""WITH {_spans(12, "doc_id // 250 AS batch,").replace("SELECT doc_id // 250 AS batch, n,", "SELECT batch, n,").replace("SELECT doc_id // 250 AS batch, n ", "SELECT batch, n ")},
    b AS (SELECT batch, token, sum(n) AS cnt FROM t GROUP BY batch, token HAVING sum(n) >= 2 OR length(token) = 1)
    SELECT token, sum(cnt)::BIGINT AS cnt FROM b GROUP BY token""")
def seed_counts_batched(spark, sf_dir):
    return seeds.seed_counts(_table(spark, sf_dir), 12, 2, batch=250)


@query(f"WITH {_COUNTS} SELECT token, cnt FROM counts WHERE length(token) = 1")
def guaranteed_tokens(spark, sf_dir):
    return _with_guaranteed(spark, sf_dir).filter(F.char_length("token") == 1)


@query(f"WITH {_COUNTS} SELECT token, cnt, round((ln(cnt) - ln((SELECT sum(cnt) FROM pruned)))::FLOAT::DOUBLE, 4) AS log_prob FROM pruned")
def log_probs(spark, sf_dir):
    return seeds.log_probs(counts_of(spark, sf_dir)).select("token", "cnt", F.round(F.col("log_prob").cast("double"), 4).alias("log_prob"))


@query(f"""WITH {_COUNTS}, multi AS MATERIALIZED (SELECT * FROM pruned WHERE length(token) > 1)
    SELECT token, cnt FROM multi ORDER BY cnt DESC, token LIMIT (SELECT floor(count(*) * {SHRINK})::BIGINT FROM multi)""")
def prune_round(spark, sf_dir):
    """One round by counts: cnt * -log_prob rises with cnt while cnt is below total / e."""
    s = Scratch(spark, "prune")
    multi = counts_of(spark, sf_dir).filter(F.char_length("token") > 1)
    return top_by_count(multi, "cnt", [F.asc("token")], int(multi.count() * SHRINK), s)


@query(f"WITH {_VOCAB} SELECT token_id, token, round(log_prob, 3) AS log_prob FROM vocab")
def vocab_ids(spark, sf_dir):
    return vocab_of(spark, sf_dir).select("token_id", F.col("token").cast("string").alias("token"), F.round(F.col("log_prob").cast("double"), 3).alias("log_prob"))


ORACLES["vocab_ids"] = ORACLES["vocab_ids"].replace("round(log_prob, 3)", "round(log_prob::DOUBLE, 3)")


@query(f"""WITH {_VOCAB} SELECT count(*) AS size, round(avg(strlen(token)), 6) AS mean_bytes, count(*) FILTER (strlen(token) > 1) AS multi_byte,
    round(100.0 * count(*) FILTER (strlen(token) > 1) / count(*), 6) AS multi_byte_percent FROM vocab""")
def vocab_stats(spark, sf_dir):
    return vocabulary.statistics(vocab_of(spark, sf_dir)).select("size", F.round("mean_bytes", 6).alias("mean_bytes"), "multi_byte", F.round("multi_byte_percent", 6).alias("multi_byte_percent"))


@query(f"WITH {_spans(MAX_BYTES)} SELECT chr(c::INT) AS token FROM (SELECT unnest(range(32, 127)) AS c) WHERE chr(c::INT) NOT IN (SELECT token FROM t)")
def missing_ascii(spark, sf_dir):
    return vocabulary.missing_ascii(seeds.seed_counts(_table(spark, sf_dir), MAX_BYTES, MIN_FREQ))


@query(f"{_encoded()} SELECT unit, count(*) AS n_edges, sum(e - s)::BIGINT AS span FROM edges GROUP BY unit")
def lattice_edges(spark, sf_dir):
    return segment.lattice_edges(unit_freq(spark, sf_dir), vocab_of(spark, sf_dir)).groupBy("unit").agg(F.count("*").alias("n_edges"), F.sum(F.col("end") - F.col("start")).alias("span"))


@query(f"{_encoded()} SELECT unit, array_to_string(ids, ' ') AS ids FROM enc")
def encode_units(spark, sf_dir):
    units = _table(spark, sf_dir).select(F.explode(T.units(F.col("text"))).alias("text")).distinct()
    return segment.encode(units, segmenter_of(spark, sf_dir)).select(F.col("text").alias("unit"), _joined().alias("ids"))


@query(f"{_encoded()} SELECT unit, array_to_string(ids, ' ') AS ids FROM du LEFT JOIN best USING (unit)")
def encode_lattice(spark, sf_dir):
    units = Scratch(spark, "lattice").write(unit_freq(spark, sf_dir).select("unit"), "units")
    return segment.lattice_encode(units, vocab_of(spark, sf_dir)).select("unit", _joined().alias("ids"))


@query(f"{_encoded()} SELECT k AS doc_id, array_to_string(ids, ' ') AS ids FROM whole")
def encode_docs(spark, sf_dir):
    return encoded(spark, sf_dir).select("doc_id", _joined().alias("ids"))


@query(f"{_encoded('conversations', 'conv_id * 100000 + turn')} SELECT k // 100000 AS conv_id, k % 100000 AS turn, array_to_string(ids, ' ') AS ids FROM whole")
def encode_conversations(spark, sf_dir):
    return encoded(spark, sf_dir, "conversations").select("conv_id", "turn", _joined().alias("ids"))


@query(f"{_encoded()} SELECT id & {T.FLAG - 1} AS token_id, count(*) AS n FROM (SELECT unnest(ids) AS id FROM whole) GROUP BY ALL")
def token_usage(spark, sf_dir):
    x = segment.count_ids(_table(spark, sf_dir), segmenter_of(spark, sf_dir))
    return x.groupBy(T.plain_id(F.col("x")).alias("token_id")).agg(F.sum("n").alias("n"))


@query(f"{_encoded()} SELECT count(*) AS n_ids, count(*) FILTER (id & {T.FLAG} <> 0) AS spaced, round(count(*) FILTER (id & {T.FLAG} <> 0) / count(*), 6) AS share FROM (SELECT unnest(ids) AS id FROM whole)")
def leading_space_share(spark, sf_dir):
    x = segment.count_ids(_table(spark, sf_dir), segmenter_of(spark, sf_dir))
    spaced = F.sum(F.when(T.has_space(F.col("x")), F.col("n")).otherwise(0))
    return x.agg(F.sum("n").alias("n_ids"), spaced.alias("spaced"), F.round(spaced / F.sum("n"), 6).alias("share"))


@query("SELECT doc_id, text AS decoded FROM documents")
def decode_docs(spark, sf_dir):
    return decode.decode(encoded(spark, sf_dir), tokens_of(spark, sf_dir)).select("doc_id", "decoded")


@query("SELECT doc_id, text AS decoded FROM documents")
def decode_by_join(spark, sf_dir):
    return decode.decode_by_join(encoded(spark, sf_dir), vocab_of(spark, sf_dir))


@query("SELECT 'lossless' AS status, count(*) AS n FROM documents")
def roundtrip_audit(spark, sf_dir):
    return metrics.round_trip(decode.decode(encoded(spark, sf_dir), tokens_of(spark, sf_dir), strict=False))


_MEASURED = """m AS (SELECT lang, count(*) AS n_docs, sum(len(ids))::BIGINT AS tokens, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes FROM documents JOIN whole ON doc_id = k GROUP BY lang)"""


@query(f"{_encoded()}, {_MEASURED} SELECT lang, n_docs, tokens, chars, bytes, round(chars / tokens, 6) AS chars_per_token, round(bytes / tokens, 6) AS bytes_per_token FROM m")
def compression_by_lang(spark, sf_dir):
    x = metrics.compression(encoded(spark, sf_dir))
    return x.withColumns({c: F.round(c, 6) for c in ("chars_per_token", "bytes_per_token")})


@query(f"""{_encoded()}, {_MEASURED} SELECT lang, round(raw, 6) AS raw_ratio, round(ch, 6) AS char_ratio, CASE WHEN ch <= 1.5 THEN 'good' WHEN ch <= 2 THEN 'fair' ELSE 'poor' END AS verdict
    FROM (SELECT m.lang, m.tokens / b.tokens AS raw, (m.tokens / m.chars) / (b.tokens / b.chars) AS ch FROM m, m b WHERE b.lang = 'en')""")
def parity_vs_en(spark, sf_dir):
    return metrics.parity(metrics.compression(encoded(spark, sf_dir)), "en").withColumns({c: F.round(c, 6) for c in ("raw_ratio", "char_ratio")})


@query(f"{_encoded()}, {_MEASURED} SELECT round((a.r - b.r) / b.r * 100, 6) AS percent, round(a.r / b.r, 6) AS times FROM (SELECT chars / tokens AS r FROM m WHERE lang = 'en') a, (SELECT chars / tokens AS r FROM m WHERE lang = 'de') b")
def improvement_en_over_de(spark, sf_dir):
    return metrics.improvement(metrics.compression(encoded(spark, sf_dir)), "lang", "en", "de", "chars_per_token").select(F.round("percent", 6).alias("percent"), F.round("times", 6).alias("times"))


@query(f"""{_encoded()} SELECT quality, toxic, count(*) AS n, sum(len(ids))::BIGINT AS tokens, sum(length(text))::BIGINT AS chars
    FROM documents JOIN whole ON doc_id = k JOIN labels USING (doc_id) GROUP BY ALL""")
def token_quality_join(spark, sf_dir):
    x = encoded(spark, sf_dir).select("doc_id", F.size("ids").alias("n"), F.char_length("text").alias("c"))
    return x.join(_table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.sum("n").alias("tokens"), F.sum("c").alias("chars"))


@query("SELECT page_id, substring(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')), 1, 60000) AS text FROM pages")
def page_text(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.page_text(F.col("html")).alias("text"))


@query("SELECT doc_id, text FROM (SELECT doc_id, trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS text FROM documents) WHERE length(text) >= 200 ORDER BY doc_id LIMIT 100")
def length_filter_topn(spark, sf_dir):
    """The capped sink of long texts: its cap is the feature."""
    return filtered(_table(spark, sf_dir), 200, 100)


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS turn FROM documents),
    k AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM documents GROUP BY lang))
    SELECT (row_number() OVER (ORDER BY turn, lang DESC) - 1)::BIGINT AS ord, doc_id, lang FROM r, k WHERE turn < least""")
def interleave_equal(spark, sf_dir):
    return interleave.round_robin(_table(spark, sf_dir)).select("ord", "doc_id", "lang")


WEIGHTS = [("de", 1.0), ("en", 2.0), ("es", 1.0), ("fr", 4.0)]


@query("""WITH w(lang, w, place) AS (VALUES ('de', 1.0::DOUBLE, 0), ('en', 2.0, -1), ('es', 1.0, -2), ('fr', 4.0, -3)),
    r AS (SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k FROM documents)
    SELECT (row_number() OVER (ORDER BY (k + 0.5) / w, place, doc_id) - 1)::BIGINT AS ord, doc_id, lang FROM r JOIN w USING (lang) WHERE regexp_matches(text, '[^""" + T.WHITE + """]')""")
def interleave_weighted(spark, sf_dir):
    return interleave.interleave(_table(spark, sf_dir), WEIGHTS, "lang").select("ord", "doc_id", "lang")


@query()
def interleave_random(spark, sf_dir):
    return interleave.interleave(_table(spark, sf_dir), WEIGHTS, "lang", method="random").select("ord", "doc_id", "lang")


@query()
def encode_whole(spark, sf_dir):
    """Each text as one stretch; the recursion of the SQL form would hold every path of every text."""
    x = segment.encode(_table(spark, sf_dir), segmenter_of(spark, sf_dir), mode="whole")
    return x.select("doc_id", _joined().alias("ids"))


@query()
def train(spark, sf_dir):
    """The whole loop at the size and with the settings of the command line; tests hold it against a plain Python version."""
    return train_vocab(_table(spark, sf_dir)).select("token_id", F.col("token").cast("string").alias("token"), F.round(F.col("log_prob").cast("double"), 3).alias("log_prob"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_by_lang(spark, sf_dir)
