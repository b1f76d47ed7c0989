"""morsel: subword vocabularies, tokenization and corpus preparation on PySpark."""

__version__ = "0.2.0"

#: Names of the package and the modules that have them; a module is loaded when its name is first asked for.
_WHERE = {
    "Tokenizer": "morsel.tokenizer",
    "Segmenter": "morsel.operators.segment",
    "Trie": "morsel.operators.kernel",
    "DecodeError": "morsel.operators.decode",
    "VocabError": "morsel.sources.vocab_files",
    "read_vocab": "morsel.sources.vocab_files",
    "write_vocab": "morsel.sources.vocab_files",
    "train_vocab": "morsel.operators.train",
    "normalize": "morsel.functions.text",
    "load_config": "morsel.sources.corpus",
    "collect_documents": "morsel.sources.corpus",
    "encode_stream": "morsel.streaming.encode",
}
__all__ = [*_WHERE]


def __getattr__(name: str):
    if name in _WHERE:
        from importlib import import_module

        return getattr(import_module(_WHERE[name]), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
