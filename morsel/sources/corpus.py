"""Corpus configurations and readers of text and JSON lines, plain or gzipped."""

from __future__ import annotations

import os
import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from morsel.functions.text import is_blank
from morsel.sources import files

READERS = ("text", "text_gz", "jsonl", "jsonl_gz")


@dataclass(frozen=True)
class Source:
    path: str
    language: str = "en"
    weight: float = 1.0
    reader: str = "text"
    text_field: str = "text"


def _parse(text: str) -> dict:
    try:
        import yaml
    except ImportError:
        return _parse_plain(text)
    return yaml.safe_load(text) or {}


def _parse_plain(text: str) -> dict:
    """The two sections of a configuration, without a YAML library."""
    out: dict = {"mix_ratios": {}, "sources": []}
    section, item = None, None
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        if not line[0].isspace() and not body.startswith("-"):
            section = body.partition(":")[0]
            continue
        if body.startswith("-"):
            item = {}
            out["sources"].append(item)
            body = body[1:].strip()
        key, _, value = body.partition(":")
        value = value.strip().strip("'\"")
        if section == "mix_ratios":
            out["mix_ratios"][key.strip()] = float(value)
        elif section == "sources" and item is not None and key:
            item[key.strip()] = value
    return out


def load_config(path: str, base_dir: str | None = None) -> list[Source]:
    """Sources of a configuration file."""
    with open(path, encoding="utf-8") as f:
        return sources_of(_parse(f.read()), base_dir)


def sources_of(c: dict, base_dir: str | None = None) -> list[Source]:
    """Sources of a configuration; weights are those of their language, 1 where there is none. Paths are relative to base_dir."""
    mix = c.get("mix_ratios") or {}
    out = []
    for s in c.get("sources") or []:
        lang = s.get("language", "en")
        out.append(Source(os.path.join(base_dir, s["path"]) if base_dir else s["path"], lang, float(mix.get(lang, 1.0)), s.get("reader", "text"), s.get("text_field", "text")))
    return out


def config_table(spark: SparkSession, sources: list[Source]) -> DataFrame:
    return spark.createDataFrame([(s.path, s.language, s.weight, s.reader, s.text_field) for s in sources], "path string, language string, weight double, reader string, text_field string")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx, text): the paragraphs of a text file or a folder of them, gzipped ones by their name.

    A paragraph is a run of lines that are not blank. Files are read by lines, in splits; each split counts its own runs, and what goes
    before it comes from one row a split, so a file of any size is read by many tasks and only a paragraph has to fit in one.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))
    w = Window.partitionBy("file", "split").orderBy("at")
    lines = raw.withColumn("blank", is_blank(F.col("line"))).withColumn("begins", ~F.col("blank") & F.coalesce(F.lag("blank").over(w), F.lit(True)))
    lines = lines.withColumn("run", F.sum(F.col("begins").cast("long")).over(w))
    each = lines.groupBy("file", "split").agg(F.max("run").alias("runs"), F.min_by("blank", "at").alias("first"), F.max_by("blank", "at").alias("last"))
    order = Window.partitionBy("file").orderBy("split")
    # a run may go on from the split before
    each = each.withColumn("on", (~F.col("first") & ~F.coalesce(F.lag("last").over(order), F.lit(True))).cast("long"))
    each = each.withColumn("base", F.sum(F.col("runs") - F.col("on")).over(order) - F.col("runs"))
    kept = lines.filter("not blank").join(each.select("file", "split", "base"), ["file", "split"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    return kept.groupBy("file", (F.col("base") + F.col("run") - 1).alias("idx")).agg(text.alias("text"))


def read_jsonl(spark: SparkSession, path: str, field: str = "text", strings_only: bool = True) -> DataFrame:
    """(file, idx, text): one string field of each line; blank or broken lines, and empty or missing values, are left out.

    idx keeps the order of lines. strings_only=False takes other values as text.
    """
    quote = next((q for q in "'\"" if q not in field), None)
    if quote is None:
        raise ValueError(f"a field name can't hold both kinds of quotes: {field}")
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("idx"), F.try_parse_json(F.trim("value")).alias("line"))
    place = f"$[{quote}{field}{quote}]"
    v, text = F.try_variant_get("line", place, "variant"), F.try_variant_get("line", place, "string")
    if strings_only:
        text = F.when(F.schema_of_variant(v) == "STRING", text)
    return lines.select("file", "idx", text.alias("text")).filter("text <> ''")


def read_source(spark: SparkSession, source: Source) -> DataFrame:
    """(file, idx, text, language); a missing file is a warning and no rows, an unknown reader an error."""
    if source.reader not in READERS:
        raise ValueError(f"unknown reader {source.reader!r}; it must be one of {', '.join(READERS)}")
    if not files.exists(spark, source.path):
        warnings.warn(f"no file at {source.path}", stacklevel=2)
        return spark.createDataFrame([], "file string, idx long, text string, language string")
    df = read_text(spark, source.path) if source.reader.startswith("text") else read_jsonl(spark, source.path, source.text_field)
    return df.withColumn("language", F.lit(source.language))


def read_sources(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """(source, file, idx, text, language) of all sources; source is its number."""
    parts = [read_source(spark, s).withColumn("source", F.lit(str(k))) for k, s in enumerate(sources)]
    if not parts:
        return spark.createDataFrame([], "file string, idx long, text string, language string, source string")
    return reduce(DataFrame.unionByName, parts)


def estimate_size(spark: SparkSession, sources: list[Source]) -> int:
    """Bytes of all source files; what can't be read counts 0."""
    return sum(files.total_size(spark, s.path) for s in sources)


def collect_documents(spark: SparkSession, sources: list[Source], max_docs: int = 0, method: str = "spread") -> DataFrame:
    """(ord, text, language): the blend of all sources by weight. method as in interleave(): "spread" has no step on the driver."""
    from morsel.operators.interleave import interleave
    from morsel.operators.ranking import global_rank
    from morsel.scratch import Scratch

    docs = read_sources(spark, sources)
    docs = global_rank(docs, [F.col("source"), F.col("file"), F.col("idx")], Scratch(spark, "collect")).withColumnRenamed("rank", "doc_id")
    weights = [(str(k), s.weight) for k, s in enumerate(sources)]
    return interleave(docs, weights, max_docs=max_docs, method=method).select("ord", "text", "language")


def write_filtered(docs: DataFrame, path: str, least: int = 200, most_docs: int | None = None, text_col: str = "text", order_col: str = "doc_id") -> None:
    """Texts of at least so many characters, stripped, as gzipped JSON lines."""
    filtered(docs, least, most_docs, text_col, order_col).select("text").write.mode("overwrite").json(path, compression="gzip")


def filtered(docs: DataFrame, least: int = 200, most_docs: int | None = None, text_col: str = "text", order_col: str = "doc_id") -> DataFrame:
    x = docs.select(order_col, F.btrim(docs[text_col], F.lit(" \t\n\r\x0b\x0c")).alias("text")).filter(F.char_length("text") >= least)
    return x.orderBy(order_col).limit(most_docs) if most_docs else x


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, text) of a JSON array of strings."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("case_id", "text"))
