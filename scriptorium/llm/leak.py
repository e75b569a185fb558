"""Passages of evaluation items inside corpus documents (problem 8).

1. One scan of the corpus: texts become words regardless of case, punctuation, markup, spacing and hyphens; where five
   words in a row may be five words in a row of some item, by a bitmap of fixed size, the neighbourhood is kept as word ids
   (checkpointed, so that the texts are read once and lost executors cost little). The scan is one however many items.
2. Counts of those n-grams over the whole corpus pick the seeds: of each window of 13 words of an item the rarest of the
   n-grams that the corpus has, several where they are as rare. A neighbourhood meets an item if they share a seed, or any
   different n-grams in EVIDENCE stretches of the item: copies edited all over are met although their edits break the rarest n-grams,
   and a common turn of phrase alone leads nowhere.
3. Smith-Waterman alignment scores each pair that meets, and its score tells what the pair is: a literal passage, an edited
   or paraphrased copy, or a likeness by chance.

Items are the stated query set. Up to ITEM_CHARS characters they are broadcast; beyond, n-grams and items meet neighbourhoods by
shuffled joins whose hot keys are salted, with the same result.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from scriptorium.llm import bitmap
from scriptorium.operators.tables import salted_join
from scriptorium.session import ready, shuffle_partitions, spread

#: Words of a seed, words of a passage that counts as leaked.
SEED, PASSAGE = 5, 13
#: Stretches of PASSAGE words of an item, each with a shared n-gram of its own that isn't a seed, by which a neighbourhood meets it.
EVIDENCE = 3
#: Words kept on either side of matching n-grams for the alignment.
MARGIN = 24
#: Smith-Waterman scores for words.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Score of a passage of PASSAGE equal words: from there on a pair is no likeness by chance.
COPY_SCORE = MATCH * PASSAGE
#: Most characters of items that are broadcast (about 30 MB as words and n-grams).
ITEM_CHARS = 6_000_000
#: Bits of the bitmap, as a power of two, for items that are broadcast and for more: 2 MB and 32 MB.
FEW_BITS, MANY_BITS = 24, 28
#: Stands for a null key where keys are joined.
NO_KEY = "\0"
#: Pairs that are aligned side by side.
PAIRS = 128
#: Texts that are searched at once, word ids kept per worker (then the cache starts anew).
SLICE, CACHE = 1_000, 400_000

_WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+")
_INVISIBLE = re.compile("[­͏᠎​-‏‪-‮⁠-⁤﻿]+")
_LINE_MARK = re.compile(r"(?m)^[ \t>*#+\-–•|]*(?:\d{1,3}[.)](?=\s))?")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐‑](?:[ \t]*\r?\n[ \t]*)?(?=[^\W\d_])")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑][ \t]*\r?\n[ \t>*#|]*(?=[^\W\d_])")
#: A short tag of any content, or one of any length that is made of attributes with values.
_TAG = re.compile(r"""<(/?)(\w+)(?:[^<>]{0,300}|(?:\s+[\w:@.\-]+\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>]+))+\s*/?)>""")
_LINK = re.compile(r"\]\([^()\s]*\)|https?://\S+")
_APOSTROPHE = re.compile(r"(?<=\w)['’ʼ‘`´](?=\w)")
_INLINE = {"a", "b", "i", "u", "em", "strong", "span", "sup", "sub", "small", "mark", "font", "tt", "code", "q", "cite"}


def passage_words(text: str) -> list[str]:
    """Words for comparison. Hyphens inside words and at line ends vanish, so a word counts once however it was broken."""
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    if "<" in text:
        text = _TAG.sub(lambda m: "" if m[2].lower() in _INLINE else " ", text)
    if "&" in text:
        text = html.unescape(text)
    if "](" in text or "://" in text:
        text = _LINK.sub(" ", text)
    if "**" in text or "~~" in text:
        text = text.replace("**", "").replace("~~", "")
    if "\n" in text:
        text = _LINE_MARK.sub("", _BROKEN.sub("", text))
    if "-" in text or "‐" in text or "‑" in text:
        text = _HYPHEN.sub("", text)
    if "'" in text or "’" in text or "`" in text:
        text = _APOSTROPHE.sub("", text)
    return _WORD.findall(text.casefold() if not text.isascii() else text.lower())


_ids: dict[str, int] = {}


def word_ids(words: list[str]) -> np.ndarray:
    """64-bit ids of words, the same on every machine."""
    get = _ids.get
    out = [get(w) for w in words]
    if None in out:
        if len(_ids) > CACHE:
            _ids.clear()
        for i, x in enumerate(out):
            if x is None:
                out[i] = _ids[words[i]] = xxhash.xxh3_64_intdigest(words[i].encode("utf-8", "surrogatepass"))
    return np.array(out, np.uint64)


def grams(ids: np.ndarray, n: int = SEED) -> np.ndarray:
    """A 64-bit key of every n words in a row."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    key = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        key = key * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - n + 1 + k] * np.uint64(0xC2B2AE3D27D4EB4F)
        key ^= key >> np.uint64(29)
    return key


def rarest(counts: np.ndarray) -> np.ndarray:
    """Which n-grams of an item are seeds, by their counts in the corpus: the least above 0 in some window of PASSAGE words."""
    size = PASSAGE - SEED + 1
    if len(counts) < size:
        return np.zeros(len(counts), bool)
    n = np.where(counts > 0, counts, np.inf)
    least = np.lib.stride_tricks.sliding_window_view(n, size).min(axis=1)
    around = np.concatenate([np.full(size - 1, -np.inf), least, np.full(size - 1, -np.inf)])
    return np.isfinite(n) & (np.lib.stride_tricks.sliding_window_view(around, size).max(axis=1) >= n)


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and their longest run of equal words in a row."""
    return align_all([(a, b)])[0]


def align_all(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Scores and longest runs of many pairs: pairs of like length are aligned side by side, row by row."""
    out: list[tuple[int, int]] = [(0, 0)] * len(pairs)
    order = sorted((i for i, (a, b) in enumerate(pairs) if len(a) and len(b)), key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    for at in range(0, len(order), PAIRS):
        chosen = order[at : at + PAIRS]
        rows, cols = max(len(pairs[i][0]) for i in chosen), max(len(pairs[i][1]) for i in chosen)
        left, right = np.zeros((len(chosen), rows), np.int64), np.zeros((len(chosen), cols), np.int64)
        for k, i in enumerate(chosen):
            left[k, : len(pairs[i][0])], right[k, : len(pairs[i][1])] = pairs[i]
        sizes = np.array([(len(pairs[i][0]), len(pairs[i][1])) for i in chosen])
        inside = np.arange(cols) < sizes[:, 1:]
        score, run = np.zeros((len(chosen), cols + 1), np.int32), np.zeros((len(chosen), cols + 1), np.int32)
        best, longest = np.zeros(len(chosen), np.int32), np.zeros(len(chosen), np.int32)
        steps = np.arange(cols + 1, dtype=np.int32) * GAP
        for r in range(rows):
            same = (right == left[:, r : r + 1]) & inside & (sizes[:, :1] > r)
            now = np.zeros_like(score)
            now[:, 1:] = np.maximum(np.maximum(score[:, :-1] + np.where(same, MATCH, MISMATCH), score[:, 1:] + GAP), 0)
            score = np.maximum.accumulate(now - steps, axis=1) + steps  # gaps along the row, for a constant gap cost
            run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
            best, longest = np.maximum(best, score.max(axis=1)), np.maximum(longest, run.max(axis=1))
        for k, i in enumerate(chosen):
            out[i] = int(best[k]), int(longest[k])
    return out


def _signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def _item_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids = [word_ids(passage_words(t)) for t in batch["t"]]
        yield pd.DataFrame({"own": batch["own"], "item_id": batch["item_id"], "ids": [_signed(x) for x in ids], "grams": [_signed(grams(x)) for x in ids]})


def _filled(keys: np.ndarray) -> np.ndarray:
    """Bits of a few n-grams."""
    bits = np.zeros(1 << FEW_BITS, bool)
    bits[bitmap.slots(keys, FEW_BITS)] = True
    return np.packbits(bits, bitorder="little")


def _neighbourhoods(docs: DataFrame, key: str, text: str, shared, bits: int, exact) -> DataFrame:
    """k, part, ids (words around matching n-grams), grams (the n-grams found there, each once)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filled = shared.value
        known = None if exact is None else exact.value
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part, out = batch.iloc[at : at + SLICE], []
                for k, t in zip(part["k"], part["t"], strict=True):
                    if not t:
                        continue
                    ids = word_ids(passage_words(t))
                    keys = grams(ids)
                    places = np.flatnonzero(bitmap.holds(filled, bitmap.slots(keys, bits)))
                    if known is not None and len(places):
                        found = np.minimum(np.searchsorted(known, keys[places]), len(known) - 1)
                        places = places[known[found] == keys[places]]
                    if not len(places):
                        continue
                    for p in np.split(places, np.flatnonzero(np.diff(places) > 2 * MARGIN) + 1):
                        near = ids[max(0, p[0] - MARGIN) : p[-1] + SEED + MARGIN]
                        out.append((k, int(p[0]), _signed(near), _signed(np.unique(keys[p]))))
                if out:
                    yield pd.DataFrame(out, columns=["k", "part", "ids", "grams"])

    rows = spread(docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")))  # as strings, large ids survive beside nulls
    return rows.mapInPandas(run, "k string, part long, ids array<long>, grams array<long>")


_SCORED = "k string, item_id long, score int, run int"


def _by_broadcast(near: DataFrame, items: list[Row]) -> DataFrame:
    """Scores of what meets, with the items' words and seeds in every worker."""
    counts = dict(near.select(F.explode("grams").alias("g")).groupBy("g").count().toPandas().itertuples(index=False, name=None))  # at most the items' own n-grams
    of: dict[int, dict[int, int]] = {}  # n-gram -> item -> bits: whether it is a seed, stretch where it stands first
    for i, r in enumerate(items):
        for pos, (g, seed) in enumerate(zip(r["grams"], rarest(np.array([counts.get(g, 0) for g in r["grams"]])), strict=True)):
            if g in counts:
                at = of.setdefault(g, {})
                at[i] = at.get(i, 2 << pos // PASSAGE) | int(seed)
    shared = near.sparkSession.sparkContext.broadcast((of, [(r["item_id"], np.array(r["ids"], np.int64)) for r in items]))

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, own = shared.value
        for batch in batches:
            met, pairs = [], []
            for k, ids, found in zip(batch["k"], batch["ids"], batch["grams"], strict=True):
                shown: dict[int, int] = {}
                for g in found.tolist():
                    for i, bits in of.get(g, {}).items():
                        shown[i] = shown.get(i, 0) | bits
                for i in sorted(i for i, bits in shown.items() if bits & 1 or bits.bit_count() >= EVIDENCE):
                    met.append((k, own[i][0]))
                    pairs.append((np.asarray(ids), own[i][1]))
            yield pd.DataFrame([(*m, *s) for m, s in zip(met, align_all(pairs), strict=True)], columns=["k", "item_id", "score", "run"])

    return near.mapInPandas(align, _SCORED)


def _by_join(near: DataFrame, items: DataFrame) -> DataFrame:
    """The same by joins on n-gram and item, for items of any number."""
    c = F.col
    near = near.withColumn("k", F.coalesce("k", F.lit(NO_KEY)))
    counts = near.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    own = items.where(F.size("ids") >= PASSAGE).select("own", F.posexplode("grams").alias("pos", "g")).join(counts, "g", "left").fillna(0, ["n"])

    def choose(rows: pd.DataFrame) -> pd.DataFrame:  # the n-grams of one item
        rows = rows.sort_values("pos")
        seeds = rows.assign(seed=rarest(rows["n"].to_numpy()), stretch=rows["pos"] // PASSAGE)[rows["n"].to_numpy() > 0]
        return seeds.groupby(["g", "own"], as_index=False).agg({"stretch": "min", "seed": "max"})

    seeds = own.groupBy("own").applyInPandas(choose, "g long, own long, stretch int, seed boolean")
    met = salted_join(near.select("k", "part", F.explode("grams").alias("g")), seeds, "g", ["k", "part"])
    met = met.groupBy("k", "part", "own").agg(F.max("seed").alias("seed"), F.size(F.collect_set("stretch")).alias("stretches"))
    met = met.where(c("seed") | (c("stretches") >= EVIDENCE)).select("k", "part", "own").checkpoint()
    pairs = met.join(near.select("k", "part", "ids"), ["k", "part"])
    pairs = salted_join(pairs, items.select("own", "item_id", c("ids").alias("item_words")), "own", ["k", "part"], hot=met)

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scores = align_all([(np.asarray(x), np.asarray(y)) for x, y in zip(b["ids"], b["item_words"], strict=True)])
            yield pd.DataFrame({"k": b["k"], "item_id": b["item_id"], "score": [s for s, _ in scores], "run": [r for _, r in scores]})

    return pairs.select("k", "item_id", "ids", "item_words").repartition(shuffle_partitions(near.sparkSession)).mapInPandas(align, _SCORED).withColumn("k", F.nullif("k", F.lit(NO_KEY)))


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """`key`, item_id, score (best Smith-Waterman score of a passage), run (longest passage of equal words) and kind.

    One row for each document and item that meet (see above). kind is `literal` for PASSAGE equal words in a row, `edited`
    for another alignment that scores as much, else `chance`. Null and empty texts on either side, items shorter than 13
    words and an empty side give no rows; repeated rows count once; of an item with several texts the best counts. Texts
    are taken whole. A passage that a third of all documents share costs each document one lookup.
    """
    c = F.col
    ready(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    rows = items.where(c(item_text).isNotNull()).select(c(item_key).cast("long").alias("item_id"), c(item_text).alias("t")).distinct()
    rows = rows.select(F.xxhash64("item_id", "t").alias("own"), "item_id", "t")
    known = rows.mapInPandas(_item_words, "own long, item_id long, ids array<long>, grams array<long>")
    if (rows.agg(F.sum(F.length("t"))).first()[0] or 0) <= ITEM_CHARS:
        held = known.collect()
        exact = np.unique(np.array([g for r in held for g in r["grams"]], np.int64).view(np.uint64))
        near = _neighbourhoods(docs, key, text, sc.broadcast(_filled(exact)), FEW_BITS, sc.broadcast(exact)).checkpoint()
        out = _by_broadcast(near, held)
    else:
        known = known.checkpoint()
        slots = known.select(F.explode("grams").alias("g")).select(F.shiftrightunsigned("g", 64 - MANY_BITS).alias("s"))
        near = _neighbourhoods(docs, key, text, sc.broadcast(bitmap.build(slots, "s", MANY_BITS)), MANY_BITS, None).checkpoint()
        out = _by_join(near, known)
    out = out.groupBy(c("k").cast(docs.schema[key].dataType).alias(key), "item_id").agg(F.max("score").alias("score"), F.max("run").alias("run"))
    kind = F.when((c("score") >= COPY_SCORE) & (c("run") >= PASSAGE), "literal").when(c("score") >= COPY_SCORE, "edited").otherwise("chance")
    return out.withColumn("kind", kind)
