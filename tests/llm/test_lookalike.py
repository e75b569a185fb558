import random

import pytest

from scriptorium.llm import lookalike as L


@pytest.mark.parametrize(
    "word, home, kind",
    [("the", "LATIN", "regular"), ("König", "LATIN", "regular"), ("тһе", "LATIN", "doubtful"), ("tһe", "LATIN", "irregular"), ("th​e", "LATIN", "irregular"), ("König", "LATIN", "irregular"), ("ｔhe", "LATIN", "irregular"), ("ﬁre", "LATIN", "irregular"), ("λόγος", "LATIN", "regular"), ("שלום", "LATIN", "regular"), ("вода", "CYRILLIC", "regular"), ("вoда", "CYRILLIC", "irregular"), ("वाक्‍य", "DEVANAGARI", "regular"), ("रो‍टी", "DEVANAGARI", "irregular"), ("it’s", "LATIN", "regular")],
)
def test_judgement(word, home, kind):
    assert L.judge(word, home) == kind


def test_walk_costs_nothing_for_lookalikes():
    trie = L.Trie()
    for w, n in (("the", 9), ("they", 3), ("König", 2), ("fire", 1)):
        trie.add(w, n)
    for odd, plain in (("тһе", "the"), ("t­he", "the"), ("König", "König"), ("ﬁre", "fire"), ("ｔｈｅｙ", "they")):
        assert trie.canonical(odd) == plain
    assert trie.canonical("thx") is None and trie.canonical("thx", L.EDIT) == "the"
    assert trie.canonical("te", L.EDIT) == "the" and trie.canonical("tthe", L.EDIT) == "the"


@pytest.mark.parametrize("back", [False, True])
def test_unknown_letters_cost_half(back):
    trie = L.Trie("LATIN", back)
    for w, n in (("shepherd", 9), ("shepherds", 3), ("stone", 5), ("store", 7)):
        trie.add(w, n)
    assert trie.canonical("shерhеяd") == "shepherd" and trie.canonical("ѕherhеrds") is None
    assert trie.canonical("ѕto1e") == "store" and trie.canonical("ѕtonе") == "stone"  # the more frequent, the cheaper
    assert trie.canonical("яhерhяяd") is None and trie.canonical("ѕhepherdess") is None


def test_tables(spark):
    rows = [("v", str(i), lang, t) for i, (lang, t) in enumerate([("en", "the old road"), ("en", "thе old road"), ("en", "“λόγος” of old"), ("en", "the оӏd road"), ("fr", "l’été !"), ("fr", "l’été"), (None, "the оld"), ("en", None), ("en", ""), ("hi", "वाक्‍य"), ("ru", "старая дорога")])]
    rows += rows[1:2]
    df = spark.createDataFrame(rows, "tbl string, row_key string, lang string, text string")
    words = spark.createDataFrame([("en", w) for w in "the old road of the".split()] + [("fr", "l’été"), (None, "old"), ("en", "оld")], "lang string, word string")
    got = {r["row_key"]: r["normal"] for r in L.normalized(df, words).collect()}
    assert got == {"1": "the old road", "3": "the old road", "4": "l’été !", "5": "l’été", "6": "the old"}
    assert L.normalized(df.limit(0), words.limit(0)).count() == 0


def test_without_a_vocabulary_the_table_decides(spark):
    df = spark.createDataFrame([("v", "1", "en", "tһe zһebra​ " + "x" * 50_000)], "tbl string, row_key string, lang string, text string")
    out = L.normalized(df, spark.createDataFrame([], "lang string, word string")).first()["normal"]
    assert out.startswith("the zhebra x")


def test_words_of_latin_letters_only_in_other_scripts(spark):
    assert L.judge("O", "GREEK") == L.judge("c", "CYRILLIC") == "doubtful"
    assert L.judge("O", "LATIN") == L.judge("lamp", "GREEK") == L.judge("O", "DEVANAGARI") == "regular"
    texts = [("el", "O"), ("el", "O ξένος ήλθε"), ("el", "Ο ξένος"), ("ru", "c"), ("ru", "он c ней"), ("ru", "lamp 3:16"), ("en", "O"), ("ru", "X"), (None, "O c")]
    df = spark.createDataFrame([("v", str(i), lang, t) for i, (lang, t) in enumerate(texts)], "tbl string, row_key string, lang string, text string")
    words = spark.createDataFrame([("el", w) for w in "Ο Ο ξένος O O O".split()] + [("ru", w) for w in "с он ней c c c".split()] + [("en", "O")], "lang string, word string")
    got = {r["row_key"]: r["normal"] for r in L.normalized(df, words).collect()}
    assert got == {"0": "Ο", "1": "Ο ξένος ήλθε", "3": "с", "4": "он с ней"}


def near_spellings(seed=4, n=300):
    """Words with one or two letters that no table knows beside a look-alike, at any place, and what they were."""
    r = random.Random(seed)
    vocabulary = sorted({"".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(6, 10))) for _ in range(2 * n)})[: 2 * n]
    out = []
    for w in vocabulary[:n]:
        at = r.sample(range(len(w)), r.choice([2, 2, 3]))
        x = list(w)
        x[at[0]] = L.LOOKALIKES[w[at[0]]][0] if w[at[0]] in L.LOOKALIKES else x[at[0]]
        for k in at[1:]:
            x[k] = r.choice("жлфя")
        if "".join(x) != w and L.judge("".join(x), "LATIN") == "irregular":
            out.append(("".join(x), w))
    return vocabulary, out


@pytest.mark.parametrize("words_a_key", [2_000, 3])
def test_the_trie_decides_near_spellings(spark, monkeypatch, words_a_key):
    """The table leaves the unknown letters; the automaton reads the words, whatever the keys are split by."""
    monkeypatch.setattr(L, "KEY_WORDS", words_a_key)
    vocabulary, cases = near_spellings()
    rows = spark.createDataFrame([("v", str(i), "en", x) for i, (x, _) in enumerate(cases)], "tbl string, row_key string, lang string, text string")
    got = {int(r["row_key"]): r["normal"] for r in L.normalized(rows, spark.createDataFrame([("en", w) for w in vocabulary], "lang string, word string")).collect()}
    right = sum(got.get(i) == w for i, (_, w) in enumerate(cases))
    by_table = sum(L.table_form(x, "LATIN") == w for x, w in cases)
    assert len(cases) > 100 and right >= (0.9 if words_a_key > 3 else 0.6) * len(cases) and by_table == 0


def test_no_key_holds_a_large_part_of_the_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(L, "KEY_WORDS", 5)
    words = [f"pre{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}tail" for i in range(400)] + ["alone"]
    vocabulary = spark.createDataFrame([("en", w, "LATIN", L.signature(w)) for w in words], "lang string, word string, home string, sig string")
    split = L._split_keys(vocabulary, 10)
    assert {"pr", "prea", "li", "liat"} <= split
    sizes = {}
    for w in words:
        k = L.key_of(L.signature(w), split)
        sizes[k] = sizes.get(k, 0) + 1
    assert max(sizes.values()) <= 10
