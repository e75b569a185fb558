import re

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import references as R

CASES = ["God's well-beloved Son, in whom I am well pleased.", "the Lord’s word", "  _x_ a--b 'q' -z", "café x", "½ x² Ⅷ 第三", "नमस्ते दुनिया", "𝒳y 𝒳", "", "---", None, "a\n b"]
PY = re.compile(r"(?:(?!_)[^\W_])+(?:['’\-](?:(?!_)[^\W_])+)*")


def test_tokens_slice_back(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "k long, t string")
    rows = T.tokens(df, ["k"], "t").collect()
    for r in rows:
        assert CASES[r["k"]][r["char_start"] : r["char_end"]] == r["surface"]
    for k, t in enumerate(CASES):
        own = [(r["idx"], r["surface"]) for r in sorted(rows, key=lambda r: r["idx"]) if r["k"] == k]
        assert own == list(enumerate(PY.findall(t or "")))


def test_gaps_and_words_give_the_text_back(spark):
    df = spark.createDataFrame([(t,) for t in CASES if t is not None], "t string")
    for r in df.select("t", F.array_join(T.interleaved(F.col("t")), "").alias("u")).collect():
        assert r["t"] == r["u"]


def test_like_ignores_ascii_case_only(spark):
    df = spark.createDataFrame([("MERCY",), ("École",), ("a\\b",), ("50% off",), (None,)], "t string")
    like = lambda q: {r["t"] for r in df.where(T.like_contains(F.col("t"), q)).collect()}
    assert like("mercy") == {"MERCY"}
    assert like("école") == set()
    assert like("a\\b") == {"a\\b"}
    assert like("5_%") == {"50% off"}
    assert df.where(T.in_book(F.lit("Gen.1.1"), "gen")).count() == 5
    assert df.where(T.in_book(F.lit("Genesis.1.1"), "Gen")).count() == 0


def test_verse_ids(spark):
    df = spark.createDataFrame([("Gen.1.2",), ("Gen",), ("Gen.x.2",), ("",)], "v string")
    got = {r["v"]: (r["p"], r["book"], r["chapter"], r["verse_no"]) for r in df.select("v", T.book_prefix(F.col("v")).alias("p"), *T.split_verse_id(F.col("v"))).collect()}
    assert got == {"Gen.1.2": ("Gen", "Gen", 1, 2), "Gen": ("", "Gen", 0, 0), "Gen.x.2": ("Gen", "Gen", 0, 2), "": ("", "", 0, 0)}


def test_display_forms(spark):
    df = spark.createDataFrame([(None, 500, "a.b.PDF", " x\t\n y "), (3725.5, 2048, ".hidden", "w" * 150), (59.9, 5 << 20, "no/ext?", "")], "s double, n long, f string, t string")
    rows = df.select(T.format_time(F.col("s")).alias("s"), T.format_bytes(F.col("n")).alias("n"), T.extension(F.col("f")).alias("e"), T.sanitize_filename(F.col("f")).alias("f"), T.preview(F.col("t")).alias("p")).collect()
    assert [r["s"] for r in rows] == ["—", "1:02:05", "0:59"]
    assert [r["n"] for r in rows] == ["500 B", "2.0 kB", "5.0 MB"]
    assert [r["e"] for r in rows] == ["pdf", "hidden", ""]
    assert [r["f"] for r in rows] == ["a.b.PDF", "hidden", "no_ext_"]
    assert rows[0]["p"] == "x y" and rows[1]["p"] == "w" * 140 + "…"


BOOKS = [("Gen", "Genesis", 50), ("Exod", "Exodus", 40), ("Ps", "Psalms", 150), ("Song", "Song of Solomon", 8), ("Eccl", "Ecclesiastes", 12), ("Isa", "Isaiah", 66), ("John", "John", 21), ("1John", "1 John", 5), ("2John", "2 John", 1), ("1Cor", "1 Corinthians", 16), ("2Cor", "2 Corinthians", 13), ("Jas", "James", 5), ("Phlm", "Philemon", 1), ("Phil", "Philippians", 4), ("Rev", "Revelation", 22)]
REFERENCES = {
    "John 3:16": ("John", 3, 16), "john 3:16": ("John", 3, 16), "  John   3 : 16  ": ("John", 3, 16), "gen1:1": ("Gen", 1, 1), "Isaiah 40.31": ("Isa", 40, 31), "Genesis 1": ("Gen", 1, None), "John": ("John", 1, None),
    "1 Cor 13": ("1Cor", 13, None), "1Cor 13:4": ("1Cor", 13, 4), "1 John 4:8": ("1John", 4, 8), "i john 4:8": ("1John", 4, 8), "first john 4:8": ("1John", 4, 8), "2 John 1": ("2John", 1, None), "psalm 23": ("Ps", 23, None), "psalms 23:1": ("Ps", 23, 1),
    "Ps 23:1": ("Ps", 23, 1), "James 1:5": ("Jas", 1, 5), "Song 2:1": ("Song", 2, 1), "Phil 4:13": ("Phil", 4, 13), "Philemon 1": ("Phlm", 1, None), "": None, "12345": None, "Hezekiah 3:1": None, "J 3:16": None, "Gen 51": None, "Ps 0": None, "Gen 1:0": ("Gen", 1, None),
}


def test_references(spark):
    books = spark.createDataFrame(BOOKS, "osis string, name string, chapter_count long")
    typed = spark.createDataFrame([(x,) for x in REFERENCES] + [(None,)], "typed string")
    got = {r["typed"]: None if r["book"] is None else (r["book"], r["chapter"], r["verse"]) for r in R.parse_references(typed, "typed", books).collect()}
    assert got == REFERENCES | {None: None}


@pytest.mark.parametrize("text, want", [("", 0.0), ("abc", 1.0), ("ab�", 0.0), ("x" * 99 + "�", 0.9)])
def test_decode_confidence(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.decode_confidence(F.col("t")).alias("c")).first()["c"] == pytest.approx(want)
