"""python -m morsel: train a vocabulary from a corpus configuration, check it and save it."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from morsel.functions.text import normalize
from morsel.operators.train import train_vocab
from morsel.operators.vocabulary import missing_ascii, statistics
from morsel.sources.corpus import collect_documents, load_config
from morsel.sources.reports import console
from morsel.sources.vocab_files import write_vocab
from morsel.tokenizer import Tokenizer


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="morsel", description=__doc__)
    p.add_argument("--config", "--corpus-config", required=True)
    p.add_argument("--base-dir", default=None)
    p.add_argument("--vocab-size", type=int, default=262_144)
    p.add_argument("--output", required=True)
    p.add_argument("--shrink-factor", type=float, default=0.75)
    p.add_argument("--max-token-len", type=int, default=32)
    p.add_argument("--min-freq", type=int, default=2)
    p.add_argument("--max-docs", type=int, default=0)
    p.add_argument("--blend", choices=("spread", "credit", "random"), default=None, help="credit and random are exact schedules made on the driver, a step a document")
    p.add_argument("--seed", type=int, default=None, help="blend by seeded draws")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    docs = collect_documents(spark, load_config(a.config, a.base_dir), a.max_docs, a.blend or ("spread" if a.seed is None else "random")).select("ord", normalize(F.col("text")).alias("text"))
    vocab = train_vocab(docs, a.vocab_size, a.max_token_len, a.shrink_factor, a.min_freq, order_col="ord").persist()
    write_vocab(vocab, a.output)
    print(console(statistics(vocab)))
    if lacking := [r[0] for r in missing_ascii(vocab).collect()]:
        print("Printable ASCII that the vocabulary lacks:", "".join(lacking))
    first = docs.orderBy("ord").select(F.substring("text", 1, 500)).first()
    if first:
        t = Tokenizer.of(vocab)
        print("Round trip of the first text:", "lossless" if t.decode(t.encode(first[0])) == first[0] else "lossy")


if __name__ == "__main__":
    main()
