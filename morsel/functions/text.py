"""Scalar functions on text as Column expressions; only canonical composition leaves the JVM, as Arrow batches."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

INVISIBLE = "[\u200B-\u200F\u202A-\u202E\uFEFF\u00AD]"
#: Two spaces or more; a word with at most one space before it; a space that is left over.
UNIT = " {2,}|(?: ?[^ ]+)| "
BYTE_WORD = "[^ \\t\\n\\x0B\\f\\r]+"
FLAG = 1 << 22
#: White space by its Unicode property.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def strip_invisible(c: Column) -> Column:
    """Without zero-width, direction and soft-hyphen characters."""
    return F.regexp_replace(c, INVISIBLE, "")


def line_endings(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def collapse_newlines(c: Column) -> Column:
    """Three line feeds or more become two."""
    return F.regexp_replace(c, "\n{3,}", "\n\n")


@F.arrow_udf(StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Canonical composition (NFC). Batches of ASCII pass as they are."""
    if pc.all(pc.string_is_ascii(text)).as_py() is not False:
        return text
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


def normalize(c: Column) -> Column:
    """Strip invisible characters, unify line ends, collapse blank lines, compose; in this order. Null stays null."""
    return nfc(collapse_newlines(line_endings(strip_invisible(c))))


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return ~F.coalesce(c, F.lit("")).rlike(f"[^{WHITE}]")


def is_single(token: Column) -> Column:
    """Whether bytes are UTF-8 of exactly one code point."""
    return F.coalesce(F.char_length(F.try_validate_utf8(token.cast("string"))) == 1, F.lit(False))


def set_space(token_id: Column) -> Column:
    """Mark that a space goes before the token."""
    return token_id.bitwiseOR(FLAG)


def has_space(token_id: Column) -> Column:
    return token_id.bitwiseAND(FLAG) != 0


def plain_id(token_id: Column) -> Column:
    """The id without its space flag; all other bits stay."""
    return token_id.bitwiseAND(F.lit(~FLAG).cast("int"))


def lead_length(byte: Column) -> Column:
    """Bytes of the UTF-8 character that begins with a byte (as a number); 1 for a byte that begins none."""
    return F.when(byte < 0xC0, 1).when(byte < 0xE0, 2).when(byte < 0xF0, 3).otherwise(4)


def units(c: Column) -> Column:
    """Encoding units of a text, in order: runs of spaces apart, words with their one leading space."""
    return F.regexp_extract_all(c, F.lit(UNIT), F.lit(0))


def without_space(unit: Column) -> Column:
    """The unit without a single leading space."""
    return F.when(unit.rlike("^ [^ ]"), F.substring(unit, 2, 2**31 - 1)).otherwise(unit)


def seed_units(c: Column) -> Column:
    """Units of a text for counting substrings: lines apart, a carriage return at their end and single leading spaces dropped."""
    lines = F.transform(F.split(c, "\n"), lambda x: units(F.regexp_replace(x, "\r$", "")))
    return F.filter(F.transform(F.flatten(lines), without_space), lambda u: u != "")


def byte_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(BYTE_WORD), F.lit(0))


def page_text(html: Column, most: int = 60_000) -> Column:
    """Text of markup: tags become spaces, white space is collapsed; cut to `most` characters, as the scrape sink asks."""
    return F.substring(F.btrim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), "[ \\t\\n\\r]+", " ")), 1, most)


def repeated_to(c: Column, size: int) -> Column:
    """The text over and over up to so many bytes; a character that the end cuts is dropped."""
    many = F.repeat(c, F.ceil(F.lit(size) / F.greatest(F.octet_length(c), F.lit(1))).cast("int"))
    cut = F.substring(many.cast("binary"), 1, size)
    tries = [F.try_validate_utf8(F.substring(cut, 1, size - k).cast("string")) for k in range(4)]
    return F.coalesce(*tries)


@F.arrow_udf(ArrayType(StructType().add("piece", StringType()).add("spaced", BooleanType())))
def pre_tokenize(text: pa.Array) -> pa.Array:
    """Pieces for code: line feeds, one marker (U+E000) for each tab or four spaces of indentation, words, other white space.

    spaced: one space stood before the word. A tab inside a line is a piece of its own.
    """
    parts, i = [], 0
    size = pc.fill_null(pc.binary_length(text), 0).to_numpy().cumsum()
    while i < len(text):
        # many pieces are held as objects only of so many bytes of texts at a time
        j = max(i + 1, int(size.searchsorted((size[i - 1] if i else 0) + (1 << 20), side="right")))
        piece: list[str] = []
        spaced: list[bool] = []
        off, null = [0], []
        for t in text.slice(i, j - i).to_pylist():
            null.append(t is None)
            _put_pieces(t or "", piece, spaced)
            off.append(len(piece))
        flat = pa.StructArray.from_arrays([pa.array(piece, pa.string()), pa.array(spaced, pa.bool_())], names=["piece", "spaced"])
        parts.append(pa.ListArray.from_arrays(pa.array(off, pa.int32()), flat, mask=pa.array(null) if any(null) else None))
        i = j
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.struct([("piece", pa.string()), ("spaced", pa.bool_())])))


def _pieces(text: str) -> list[dict]:
    piece: list[str] = []
    spaced: list[bool] = []
    _put_pieces(text, piece, spaced)
    return [{"piece": p, "spaced": s} for p, s in zip(piece, spaced)]


def _put_pieces(text: str, piece: list[str], spaced: list[bool]) -> None:
    """Append a text's pieces."""

    def put(p: str, s: bool = False) -> None:
        piece.append(p)
        spaced.append(s)

    if not text:
        return
    for k, line in enumerate(text.split("\n")):
        if k:
            put("\n")
        i = 0
        while line[i : i + 1] == "\t" or line[i : i + 4] == "    ":
            i += 1 if line[i] == "\t" else 4
            put("\ue000")
        while i < len(line):
            c = line[i]
            if c == " " and line[i + 1 : i + 2] not in ("", " ", "\t"):
                j = i + 1
            elif c in " \t":
                put(c)
                i += 1
                continue
            else:
                j = i
            end = j
            while end < len(line) and line[end] not in " \t":
                end += 1
            put(line[j:end], j > i)
            i = end
