import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from morsel.functions import text as T
from morsel.operators.segment import _UNIT


def one(spark, c, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(c).collect()]


def test_normalize(spark):
    got = one(spark, T.normalize(F.col("text")), "é", "a​b­", "a\r\nb\rc", "a\n\n\n\nb", "a\n​\n\nb", None, "")
    assert got == ["\xe9", "ab", "a\nb\nc", "a\n\nb", "a\n\nb", None, ""]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a \n\tb", max_size=12))
def test_units_cover_the_text(t):
    found = _UNIT.findall(t)
    assert "".join(found) == t
    for u in found:
        assert set(u) == {" "} or " " not in u[1:]


def test_units_and_words(spark):
    assert one(spark, T.units(F.col("text")), "    if x:  y ", "", "a b") == [["    ", "if", " x:", "  ", "y", " "], [], ["a", " b"]]
    assert one(spark, T.seed_units(F.col("text")), "ab cd\r\n  e ") == [["ab", "cd", "  ", "e", " "]]
    assert one(spark, T.byte_words(F.col("text")), "a\tb  c\xa0d") == [["a", "b", "c\xa0d"]]


def test_flags_and_bytes(spark):
    df = spark.createDataFrame([(5,)], "x int")
    assert df.select(T.set_space(F.col("x")), T.plain_id(T.set_space(F.col("x"))), T.has_space(F.col("x")), T.has_space(T.set_space(F.col("x")))).first()[:] == (5 | 1 << 22, 5, False, True)
    b = spark.createDataFrame([(65,), (0x82,), (0xC3,), (0xE2,), (0xF0,)], "b int")
    assert [r[0] for r in b.select(T.lead_length(F.col("b"))).collect()] == [1, 1, 2, 3, 4]
    t = spark.createDataFrame([(bytearray(x),) for x in (b"a", b"ab", "é".encode(), b"\xc3", b"")], "t binary")
    assert [r[0] for r in t.select(T.is_single(F.col("t"))).collect()] == [True, False, True, False, False]


def test_pages_payloads_and_blanks(spark):
    assert one(spark, T.page_text(F.col("text"), 5), "<p>a&amp;\n <b>b</b></p>", None) == ["a&amp"[:5], None]
    got = one(spark, T.repeated_to(F.col("text"), 7), "aé", "abc")
    assert got == ["aéaéa", "abcabca"] and len(got[0].encode()) == 7
    assert one(spark, T.repeated_to(F.col("text"), 5), "aé") == ["aéa"]
    assert one(spark, T.is_blank(F.col("text")), None, "", " \n", "x") == [True, True, True, False]


def test_pre_tokenize():
    pieces = lambda t: [(x["piece"], x["spaced"]) for x in T._pieces(t)]
    assert pieces("\t    x = 1\ny") == [("", False), ("", False), ("x", False), ("=", True), ("1", True), ("\n", False), ("y", False)]
    assert pieces("a\tb  c ") == [("a", False), ("\t", False), ("b", False), (" ", False), ("c", True), (" ", False)]
    assert T.nfc.func(pa.array(["a", None])).to_pylist() == ["a", None]


def test_blank_by_unicode(spark):
    rows = ["\u3000\u00a0 \t\u2028", "", None, "\u200b", "x", "\u3000x", "\x1c"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(rows)), "i int, t string").orderBy("i").select(T.is_blank(F.col("t"))).collect()]
    assert got == [t is None or not t.strip("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000") for t in rows]
