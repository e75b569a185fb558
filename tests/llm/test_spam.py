import math
import random

from scriptorium.llm import spam

NOUNS = "river lamp bread letter house shepherd mercy harvest window garden teacher road market brother winter table silver mountain candle promise".split()
VERBS = "carried opened kept lost heard sent found broke raised hid".split()


def prose(r, n=12):
    return " ".join(f"The {r.choice(NOUNS)} of the {r.choice(NOUNS)} {r.choice(VERBS)} a {r.choice(NOUNS)} near the {r.choice(NOUNS)}." for _ in range(n))


def corpus():
    r = random.Random(5)
    good = [prose(r) for _ in range(400)]
    index = "Index\n" + "\n".join(f"{n} — Ard {k}:{k + 3}; Bel {k}.2" for k, n in enumerate(NOUNS))
    litany = "\n".join(f"For the {r.choice(VERBS)} {n}, hear us, keeper of the gate." for n in NOUNS)
    tail = prose(r) + "\nhttps://a.example/x https://b.example/y #lamp #mercy"
    traps = [index, litany, tail, "lamp lamp", "", None, "   ", "A\n" * 3]
    salad = " ".join(f"#{r.choice(NOUNS + VERBS)}" for _ in range(80))
    links = "\n".join(f"Buy {r.choice(NOUNS)} rings - https://shop.example/{k}" for k in range(30))
    stuffed = "cheap rings online cheap rings now cheap rings sale cheap rings best " * 12
    goods = " | ".join(f"SKU-{k} {r.choice(NOUNS)} rings £{k}.99 in stock" for k in range(30))
    return good + traps, [salad, links, stuffed, goods, prose(r, 2) + "\n\n" + stuffed]


def test_spam_is_found_and_traps_are_not(spark):
    good, bad = corpus()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(good + bad)], "doc_id long, text string, words string").repartition(3)
    rows = {r["doc_id"]: r for r in spam.spam_scores(df).collect()}
    assert len(rows) == len(good) + len(bad)
    assert {k for k, r in rows.items() if r["is_spam"]} == set(range(len(good), len(good) + len(bad)))


def test_empty_table_and_null_keys(spark):
    assert spam.spam_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spam.spam_scores(spark.createDataFrame([(None, "a b c"), (2**60 + 1, None)], "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in rows} == {None, 2**60 + 1} and not any(r["is_spam"] for r in rows)


def test_batches_that_end_in_empty_texts(spark):
    judge = spam.Judge(*spam.corpus_counts(spark.createDataFrame([("a b c",)], "text string")))
    for texts in (["a b c", "", None], ["", ""], [None], [], ["a"], ["a b", "", "c d"], ["x " * 100_000]):
        assert len(judge.scores(texts)) == len(texts)


def test_counts_are_those_of_all_texts(spark):
    words, pairs = spam.corpus_counts(spark.createDataFrame([("a b a b",), ("a b",), (None,)], "text string").repartition(2))
    assert words.sum() == 6 and pairs.sum() == 4 and pairs.max() == 3


def test_thinly_stuffed_pages_are_judged_by_unit(spark):
    r = random.Random(7)
    good, _ = corpus()
    unit = "cheap rings {} {} cheap rings {} {} {} cheap rings {} {} {} cheap rings {} {}."
    rare = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(4))
    page = " ".join(unit.format(*[rare() for _ in range(10)]) + " " + " ".join(rare() for _ in range(14)) + "." for _ in range(12))
    judge = spam.Judge(*spam.corpus_counts(spark.createDataFrame([(t,) for t in [*good, page]], "text string")))
    words, _, share, stuffed = judge.score(page)
    assert share > spam.SPAM_SHARE and stuffed >= spam.STUFFED_SHARE, (words, share, stuffed)


def test_bare_links_are_words(spark):
    r = random.Random(9)
    good, _ = corpus()
    judge = spam.Judge(*spam.corpus_counts(spark.createDataFrame([(t,) for t in good], "text string")))
    bare = [f"https://shop{k}.example/p/{k}?q=a.b" for k in range(300)]
    foot = "\n" + prose(r, 2)
    for page in ("\n".join(bare), " ".join(bare), ". ".join(bare) + ".", "\n".join(bare) + foot, "".join(f'<a href="{u}"> </a>\n' for u in bare) + foot):
        words, _, share, _ = judge.score(page)
        assert words >= 300 and share > 0.8, (page[:80], words, share)
    few = prose(r, 6) + " See https://a.example/x. " + prose(r, 6) + "\n" + "\n".join(bare[:4])
    assert judge.score(few)[2] < 0.2 and judge.score(None) == judge.score("") == (0, 0.0, 0.0, 0.0)
    assert judge.score("https://a.example/x")[0] == 1


def test_scores_are_by_exact_counts(spark):
    r = random.Random(11)
    texts = [" ".join(f"{r.choice('abcdefgh')}{r.choice(NOUNS)}{r.randrange(10**9):x}".translate(str.maketrans("0123456789", "ghijklmnop")) for _ in range(40)) for _ in range(1500)] + ["rare pair " + prose(r, 2)] * 3 + [None, "", "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    words, pairs = {}, {}
    for t in texts:
        ws = spam.words_of(t or "")
        for w in ws:
            words[w] = words.get(w, 0) + 1
        for p in zip(ws, ws[1:]):
            pairs[p] = pairs.get(p, 0) + 1
    total = sum(words.values())
    rows = spam.spam_scores(df).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ws = spam.words_of(texts[row["doc_id"]] or "")
        pmi = [math.log(pairs[a, b] * total / words[a] / words[b]) for a, b in zip(ws, ws[1:])]
        assert row["words"] == len(ws) and abs(row["mean_pmi"] - sum(pmi) / max(1, len(pmi))) < 1e-6
