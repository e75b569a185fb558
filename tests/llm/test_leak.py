import random

import numpy as np
import pytest

from scriptorium.llm import leak

ITEM = "the quick envoy carried a sealed letter over the old stone bridge while every watcher slept beside the river until the morning bell"


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(docs)], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in leak.leaks(d, i).collect()}


def test_forms_of_a_passage(spark):
    w = ITEM.split()
    docs = [
        "Before. " + ITEM.upper().replace(" ", "  ") + " after", ITEM.replace(" ", "\n> "), ITEM.replace("letter", "let-\nter").replace(" ", " **", 1), "<p>" + ITEM.replace("sealed", "<b>sealed</b>") + "</p>", ITEM.replace("bridge", "bri­dge").replace(" ", " "),
        " ".join(w[:13]), " ".join(w[:12]), " ".join(w[:8] + ["new"] + w[8:20]), None, "", "   ", "nothing of it", ("filler words here. " * 4000) + ITEM,
    ]
    got = found(spark, docs, [(1, ITEM), (1, ITEM), (2, None), (3, ""), (4, "too short"), (5, "one two three four five six")])
    literal = {d for (d, i), r in got.items() if r["run"] >= leak.PASSAGE and i == 1}
    assert literal == {0, 1, 2, 3, 4, 5, 12}
    assert got[7, 1]["run"] == 12 and got[7, 1]["score"] > 30 and got[7, 1]["kind"] == "edited"


def test_against_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(40))) for i in range(12)]
    docs = []
    for _ in range(80):
        words = [r.choice(vocabulary) for _ in range(50)]
        src = r.choice(items)[1].split()
        n, at = r.randint(8, 25), r.randint(0, 15)
        words[10 : 10 + n] = src[at : at + n]
        docs.append(" ".join(words))
    want = set()
    for d, t in enumerate(docs):
        w = t.split()
        runs = {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
        for i, s in items:
            v = s.split()
            if any(tuple(v[k : k + 13]) in runs for k in range(len(v) - 12)):
                want.add((d, i))
    assert {k for k, x in found(spark, docs, items).items() if x["run"] >= 13} == want


def edited(text, r, share=None, every=None):
    w = text.split()
    for k in range(len(w)):
        if (r.random() < share) if share else k % every == every - 1:
            w[k] = f"other{r.randint(0, 10**9)}"
    return " ".join(w)


@pytest.mark.parametrize("limit", [leak.ITEM_CHARS, 0])
def test_edited_copies_without_a_whole_one_in_the_corpus(spark, monkeypatch, limit):
    """Every copy that the alignment of all texts with all items scores as one is found, though its edits break the rarest n-grams."""
    monkeypatch.setattr(leak, "ITEM_CHARS", limit)
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(200 if i < 4 else 60))) for i in range(24)]
    docs, made = [], []
    for i, t in items:
        if i < 4:
            docs += [edited(t, r, every=k) for k in (8, 10, 12, 13)]
            made += [i] * 4
        else:
            docs += [edited(t, r, share=s) for s in (0.10, 0.15)]
            made += [i] * 2
    docs += [" ".join(r.choice(vocabulary) for _ in range(80)) for _ in range(20)]
    words = [leak.word_ids(leak.passage_words(t)) for t in docs]
    own = [(i, leak.word_ids(leak.passage_words(t))) for i, t in items]
    want = {(d, i) for d, w in enumerate(words) for i, v in own if leak.smith_waterman(w, v)[0] >= leak.COPY_SCORE}
    got = {k for k, x in found(spark, docs, items).items() if x["kind"] in ("edited", "literal")}
    assert got <= want and len(got) >= 0.98 * len(want)
    assert want >= set(enumerate(made)) and {k for k in got if k[0] < 16} == set(enumerate(made[:16]))


@pytest.mark.parametrize("limit", [leak.ITEM_CHARS, 0])
def test_a_copy_that_lacks_the_rarest_n_grams_is_met_by_several(spark, monkeypatch, limit):
    """Twenty copies with the same edits and one whole copy: all n-grams that the whole one alone has are rarer."""
    monkeypatch.setattr(leak, "ITEM_CHARS", limit)
    r = random.Random(8)
    item = " ".join(f"w{r.randint(0, 500)}" for _ in range(60))
    same = edited(item, r, every=9)
    got = found(spark, [same] * 20 + [item], [(1, item)])
    assert len(got) == 21 and {x["kind"] for (d, _), x in got.items() if d < 20} == {"edited"} and got[20, 1]["kind"] == "literal"


def test_joins_give_the_same_as_broadcasts(spark, monkeypatch):
    items = [(k, f"a{k} " + ITEM) for k in range(4)] + [(9, ITEM), (9, ITEM.upper()), (None, ITEM)]
    docs = [ITEM, "x", ITEM[40:], None, ITEM + " and " + ITEM]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(docs)] + [(None, ITEM), (0, ITEM)], "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, leak.leaks(d, i).collect()))
    monkeypatch.setattr(leak, "ITEM_CHARS", 0)
    assert sorted(map(str, leak.leaks(d, i).collect())) == whole and len(whole) == 24
    from scriptorium.operators import tables

    monkeypatch.setattr(tables, "HOT_ROWS", 1)
    assert sorted(map(str, leak.leaks(d, i).collect())) == whole


def test_long_tags_do_not_split_a_passage(spark):
    tag = '<span style="' + "color: red; " * 60 + '">'
    assert found(spark, [ITEM.replace("letter", tag + "letter</span>")], [(1, ITEM)])[0, 1]["run"] == 23


def test_empty_sides(spark):
    assert found(spark, [], [(1, ITEM)]) == {} and found(spark, [ITEM], []) == {}
    assert found(spark, [ITEM, None], [(1, None), (2, ""), (3, "too short")]) == {}


def test_smith_waterman():
    a, b = np.array([1, 2, 3, 9, 4, 5]), np.array([7, 1, 2, 3, 4, 5, 8])
    assert leak.smith_waterman(a, b) == (9, 3)
    assert leak.smith_waterman(a, np.zeros(0, int)) == (0, 0)


def test_alignment_side_by_side_equals_a_plain_table():
    r = random.Random(2)

    def plain(a, b):
        h, run, best, longest = {}, {}, 0, 0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                same = a[i - 1] == b[j - 1]
                h[i, j] = max(0, h.get((i - 1, j - 1), 0) + (leak.MATCH if same else leak.MISMATCH), h.get((i - 1, j), 0) + leak.GAP, h.get((i, j - 1), 0) + leak.GAP)
                run[i, j] = run.get((i - 1, j - 1), 0) + 1 if same else 0
                best, longest = max(best, h[i, j]), max(longest, run[i, j])
        return best, longest

    pairs = [([r.randint(0, 4) for _ in range(r.randint(0, 30))], [r.randint(0, 4) for _ in range(r.randint(0, 20))]) for _ in range(300)]
    assert leak.align_all([(np.array(a, np.int64), np.array(b, np.int64)) for a, b in pairs]) == [plain(a, b) for a, b in pairs]
