import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import annotations as A
from scriptorium.operators import corpus as C
from scriptorium.operators import extraction as X
from scriptorium.operators import tables as M
from scriptorium.sources import files

ANCHOR = "id long, note_id long, anchor_type string, verse_id string, translation_id long, token_idx long, surface string"


def test_marks_of_another_translation(spark):
    a = spark.createDataFrame([(1, 1, "word", "Gen.1.1", 1, 2, "x"), (2, 2, "verse", "Gen.1.1", None, None, None), (3, 3, "word", "Gen.1.1", None, 2, "x")], ANCHOR)
    marks = lambda active: {(r["token_idx"], r["count"], r["degraded"]) for r in A.note_marks(a, active).collect()}
    assert marks(2) == {(None, 2, 1)}
    assert marks(1) == {(2, 1, 0), (None, 2, 0)}
    assert {r["id"] for r in A.at_verse(a, "Gen.1.1", 2).collect()} == {1, 2}
    assert {r["id"]: r["d"] for r in a.select("id", A.degraded(1).alias("d")).collect()} == {1: False, 2: False, 3: True}


def test_anchors_are_normalized(spark):
    a = spark.createDataFrame([(1, 1, "verse", "Gen.1.1", 1, 2, "x"), (2, 2, "word", "Gen.1.1", None, 2, "x"), (3, 3, "paragraph", "Gen.1.1", 1, 2, "x")], ANCHOR)
    rows = {r["id"]: r for r in a.select("id", *A.normalized_anchor()).collect()}
    assert rows[1]["translation_id"] is None and rows[1]["error"] is None
    assert rows[2]["error"] and rows[3]["error"]


def test_library_fans_out_and_keeps_loose_notes(spark):
    notes = spark.createDataFrame([(1, "a"), (2, "b")], "note_id long, body string")
    anchors = spark.createDataFrame([(1, 1, "verse", "Gen.1.1", None, None, None), (2, 1, "word", "Exod.1.1", 1, 0, "x")], ANCHOR)
    books = spark.createDataFrame([("Gen", 1, "Genesis", "OT"), ("Exod", 2, "Exodus", "OT")], "osis string, canonical_order long, name string, testament string")
    t = spark.createDataFrame([(1, "WEB")], "id long, abbrev string")
    rows = A.library(notes, anchors, t, books).collect()
    assert sorted((r["note_id"], r["book_name"] or "") for r in rows) == [(1, "Exodus"), (1, "Genesis"), (2, "")]
    assert A.standalone(notes, anchors).first()["note_id"] == 2


def test_canonical_order_and_neighbours(spark):
    v = spark.createDataFrame([(t, f"{b}.{ch}.{n}", b, ch, n) for t in (1, 2) for b in ("B", "A") for ch in (1, 2) for n in (2, 1, 3)], "translation_id long, verse_id string, book_osis string, chapter long, verse long")
    rows = C.canonical_order(v, C.books_of(v)).where("translation_id = 2").orderBy("running").collect()
    assert [r["running"] for r in rows] == list(range(1, 13)) and rows[0]["verse_id"] == "A.1.1" and rows[-1]["verse_id"] == "B.2.3"
    books = spark.createDataFrame([("A", 1, 2), ("B", 2, 0), ("C", 3, 1)], "osis string, canonical_order long, chapter_count long")
    got = {(r["osis"], r["chapter"]): (r["previous"], r["following"]) for r in C.neighbours(books).collect()}
    assert got == {("A", 1): (None, "A.2"), ("A", 2): ("A.1", "C.1"), ("C", 1): ("A.2", None)}


def test_table_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N"), (3, "C")], "k long, v string")
    rows = lambda df: sorted((r["k"] or 0, r["v"]) for r in df.collect())
    assert rows(M.insert_or_ignore(old, new, ["k"])) == [(0, "n"), (1, "a"), (2, "b"), (3, "C")]
    assert rows(M.upsert(old, new, ["k"])) == [(0, "N"), (1, "a"), (2, "B"), (3, "C")]
    assert rows(M.upsert(M.upsert(old, new, ["k"]), new, ["k"])) == rows(M.upsert(old, new, ["k"]))
    assert rows(M.replace_group(old, new.where("k = 2"), ["k"])) == [(0, "n"), (1, "a"), (2, "B")]
    assert rows(M.delete(old, new, ["k"])) == [(1, "a")]
    assert rows(M.update(old, new, "k", ["v"])) == [(0, "n"), (1, "a"), (2, "B")]
    empty = spark.createDataFrame([], "k long, v string")
    assert rows(M.upsert(empty, new, ["k"])) == [(0, "N"), (2, "B"), (3, "C")] and rows(M.upsert(old, empty, ["k"])) == rows(old)


@pytest.mark.parametrize("got, want", [([3, 4], None), ([3, 9999], "extra"), ([3], "missing"), ([3, 3, 4], "twice")])
def test_index_errors(spark, got, want):
    df = spark.createDataFrame([([3, 4], got)], "e array<long>, g array<long>")
    assert df.select(M.index_errors(F.col("e"), F.col("g")).alias("x")).first()["x"] == want


def test_speakers_by_time(spark):
    seg = spark.createDataFrame([(1, 0, 0.0, 2.0), (1, 1, 2.0, 2.0), (1, 2, 9.0, 10.0), (1, 3, 4.0, None), (1, 4, 4.0, 6.0)], "doc_id long, span_id long, start_s double, end_s double")
    turns = spark.createDataFrame([(1, 0, 0.0, 2.0, "A"), (1, 1, 0.0, 2.0, "B"), (1, 2, 3.0, 7.0, "C"), (1, 3, 4.0, 7.0, "D")], "doc_id long, turn_no long, turn_start double, turn_end double, turn_speaker string")
    got = {r["span_id"]: r["label"] for r in X.label_speakers(seg, turns, ["doc_id"], "span_id").collect()}
    assert got == {0: "A", 1: None, 2: None, 3: None, 4: "C"}


def test_confidences(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 0.9), (2, None), (2, 0.5), (3, None)], "doc_id long, confidence double")
    rows = {r["doc_id"]: (r["a"], r["b"], r["c"]) for r in df.groupBy("doc_id").agg(X.scan_confidence().alias("a"), X.speech_confidence().alias("b"), X.known_confidence().alias("c")).collect()}
    assert rows == {1: (0.0, 0.9, 0.0), 2: (0.0, 0.5, 0.5), 3: (0.0, 1.0, 1.0)}
    one = spark.createDataFrame([(None,), (-10.0,), (0.0,)], "x double").select(X.log_confidence(F.col("x")).alias("c")).collect()
    assert [r["c"] for r in one] == [None, 0.0, 1.0]


def test_text_is_rebuilt_in_order(spark):
    s = spark.createDataFrame([(1, 1, 2, "second"), (1, 2, 0, " "), (1, 3, 1, "first"), (2, 4, 0, "")], "doc_id long, span_id long, idx long, text string")
    assert [(r["doc_id"], r["text"]) for r in X.rebuilt_text(s).collect()] == [(1, "first\nsecond")]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Line öne\n".encode())
    (tmp_path / "b.txt").write_bytes(b"The Lord\x92s word")
    got = {r["path"].rsplit("/", 1)[1]: (r["engine"], r["confidence"]) for r in files.read_plain(spark, f"{tmp_path}/*.txt").collect()}
    assert got == {"a.txt": ("text/utf-8", 1.0), "b.txt": ("text/latin-1", 0.6)}
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t><w:tab/><w:t>x</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "d.docx").write_bytes(b"this is not a zip")
    docs = {r["path"].rsplit("/", 1)[1]: r for r in files.read_docx(spark, f"{tmp_path}/*.docx").collect()}
    assert docs["c.docx"]["text"] == "One\nTwo\tx" and docs["d.docx"]["text"] is None and "docx" in docs["d.docx"]["error"]
    (tmp_path / "book.json").write_text('{"chapters":[{"chapter":1,"verses":[{"verse":1,"text":" In the beginning "}]},{"chapter":"2","verses":[{"verse":"3","text":"Second"},{"verse":4}]}]}')
    verses = files.read_books(spark, f"{tmp_path}/book.json").orderBy("position").collect()
    assert [(r["chapter"], r["verse"], r["text"]) for r in verses] == [(1, 1, "In the beginning"), (2, 3, "Second"), (2, 4, "")]


def test_settings_file(spark):
    lines = spark.createDataFrame([(x,) for x in ["# c", "", "export A='x y'", "B=1=2", 'C="q', "SECRET=z", "no pair", " D = 'a\" ", None]], "value string")
    assert {r["key"]: r["value"] for r in files.settings(lines, "value", ("SECRET",)).collect()} == {"A": "x y", "B": "1=2", "C": '"q', "D": "'a\""}


def test_staged_files(spark):
    from scriptorium.session import scratch

    folder = scratch(spark)
    texts = spark.createDataFrame([("1.docx", "one\ttwo\nthree"), ("2.docx", " "), ("3.docx", None)], "name string, text string")
    assert files.stage(texts, folder, "name", "text", files.docx_bytes).count() == 2
    got = {r["path"][-6:]: (r["text"], r["error"]) for r in files.read_docx(spark, folder).collect()}
    assert got == {"1.docx": ("one\ttwo\nthree", None), "2.docx": (None, "docx without text")}
    sizes = {r["name"]: r["content"] is None for r in files.read_bytes(spark, folder, texts, "name").collect()}
    assert sizes == {"1.docx": False, "2.docx": False, "3.docx": True}


def test_ids_of_new_rows_follow_the_order(spark):
    from scriptorium.operators import tables

    new = spark.createDataFrame([(f"n{k:03d}",) for k in range(200)], "title string").repartition(7)
    old = spark.createDataFrame([(41,), (7,)], "id long")
    got = [r["title"] for r in tables.next_ids(new, old, "id", ["title"]).orderBy("id").collect()]
    assert got == [f"n{k:03d}" for k in range(200)] and tables.next_ids(new, old.limit(0), "id", ["title"]).agg({"id": "min"}).first()[0] == 1
    assert tables.next_ids(new.limit(0), old, "id", ["title"]).count() == 0


def test_text_layers_and_second_readings(spark):
    from scriptorium.operators import extraction as X

    pages = spark.createDataFrame([(1, 1, " a "), (1, 2, None), (1, 3, "b"), (2, 1, " "), (3, 1, "x" * 250)], "doc_id long, page_no long, text string")
    got = {r["doc_id"]: (r["text"], r["confidence"], r["error"]) for r in X.text_layer(pages).collect()}
    assert got == {1: ("a\n\nb", 0.3, None), 2: (None, None, "no text layer"), 3: ("x" * 250, 1.0, None)}
    spans = spark.createDataFrame([(1, 1, 0, "old", 0.5), (2, 1, 1, "keep", 0.5), (3, 2, 0, "none", None)], "span_id long, doc_id long, idx long, text string, confidence double")
    merged = X.merge_readings(spans, spark.createDataFrame([(1, "new"), (2, " ")], "span_id long, reading string"), ["span_id"])
    assert {r["span_id"]: (r["text"], r["confidence"]) for r in merged.collect()} == {1: ("new", None), 2: ("keep", 0.0), 3: ("none", 0.0)}
    assert {r["doc_id"]: (r["text"], r["error"]) for r in X.second_reading(merged, F.lit("scan")).collect()} == {1: ("new\nkeep", None), 2: (None, "no line was read")}


def test_time_is_given_not_taken(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 23, 0),)], "t timestamp")
    assert str(df.select(F.to_date(F.from_utc_timestamp("t", "+02:00")).alias("d")).first()["d"]) == "2024-01-02"
