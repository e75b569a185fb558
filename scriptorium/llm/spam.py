"""Keyword-stuffed pages, link lists and product or tag lists (problem 9).

Words and neighbouring words of the whole corpus are counted exactly, by 63-bit keys: texts are dealt into blocks by hash,
each block sends its distinct keys, and gets back their counts over all blocks. With them the pointwise mutual information
(PMI) of every neighbouring pair is taken, and each unit of a text (sentence or line) is looked at:

- word salad: the mean PMI of a unit's pairs is far below that of prose;
- stuffed unit: pairs of words come back so often that they cover most of the unit;
- entry: a line of a list of links, goods or tags, that is without an end of sentence and with links, prices or tags;
  its collocations come back in the document. A link counts as a word; units of links only are entries.

A document is spam if such units hold most of its words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import ready, shuffle_partitions, spread

#: Characters of a block, about; a block is held by one task at once.
BLOCK_CHARS = 8_000_000
#: Key under which the number of all words travels.
TOTAL = -1
#: Mean PMI in nats below which a unit of at least SALAD_WORDS words is salad; prose of any language lies above 2.
SALAD_PMI, SALAD_WORDS = 1.45, 24
#: The same for shorter units, whose means vary more.
SHORT_SALAD_PMI, SHORT_SALAD_WORDS = 1.0, 12
#: Times that a pair must occur in a unit to count as stuffing there, and the share of the unit's words such pairs cover.
STUFFED_TIMES, STUFFED_SHARE = 3, 0.4
#: Share of the words of a unit without an end of sentence that stuffing must cover: prose that lost its stops is one long unit.
STUFFED_OPEN_SHARE = 0.55
#: Share of a document's words in such units that makes it spam, and the fewest words to judge by.
SPAM_SHARE, LEAST_WORDS = 0.5, 12
#: Words of an entry per link, price or tag.
MARK_WORDS = 12
#: Word ids kept per worker; then the cache starts anew.
CACHE = 400_000
#: Texts that are counted and scored at once.
SLICE = 1_000

#: Stand for a link, and for the end of one, which is no word.
LINK, LINK_END = "\ue000", "\ue001"

_WORD = re.compile(r"\ue000|[぀-ヿ㐀-鿿]|[^\W\d_぀-ヿ㐀-鿿]+(?:['’][^\W\d_]+)*")
_LINK = re.compile(r"(?:https?://|www\.)[^\s)\"'<>\]]+|</?a\b[^>]*>", re.I)
_UNIT = re.compile(r"(?<=[.!?;…])[\"'”’)»]*\s+(?=\W*[^\W_])|(?<=[。।！？])|\n+")
_END = re.compile(r"[.!?;:…。।！？][\"'”’)»*_\]]*\s*$")
_GOODS = re.compile(r"[£$€¥₹]\s?\d|\d\s?[£$€¥₹]|\bsku\b|-\d+ ?%|#\w+", re.I)

_ids: dict[str, int] = {}


def _word_ids(words: list[str]) -> np.ndarray:
    """64-bit ids of words, the same on every machine."""
    get = _ids.get
    out = [get(w, -1) for w in words]
    if -1 in out:
        if len(_ids) > CACHE:
            _ids.clear()
        for i, x in enumerate(out):
            if x < 0:
                digest = hashlib.blake2b(words[i].encode("utf-8", "surrogatepass"), digest_size=8).digest()
                out[i] = _ids[words[i]] = int.from_bytes(digest, "little")
    return np.array(out, np.uint64)


def _keys(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of words and of neighbouring pairs: even ones and odd ones, never TOTAL."""
    x = ids[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (ids[1:] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    pairs = (x | np.uint64(1)).view(np.int64)
    return (ids & ~np.uint64(1)).view(np.int64), np.where(pairs == TOTAL, 1, pairs)


def _linked(text: str) -> bool:
    return "://" in text or "www." in text.lower() or "<a" in text.lower()


def _mark_link(m: re.Match) -> str:
    if m[0].startswith("</"):
        return LINK_END
    return f" {LINK}{m[0][len(m[0].rstrip('.!?;…。')) :]} "


def with_links(text: str) -> str:
    """The text with a sign for each link; a full stop behind an address stays."""
    text = text.replace(LINK, " ").replace(LINK_END, " ") if LINK in text or LINK_END in text else text
    return _LINK.sub(_mark_link, text) if _linked(text) else text


def words_of(text: str) -> list[str]:
    """Words in lower case; each link is one."""
    return _WORD.findall(with_links(text).lower())


def _flat(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids of many texts in a row, where each text starts, and which neighbours lie in one text."""
    flat: list[str] = []
    starts = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts, 1):
        if t:
            flat += words_of(t)
        starts[i] = len(flat)
    inside = np.ones(max(0, len(flat) - 1), bool)
    cut = starts[1:-1]
    inside[cut[(cut > 0) & (cut < len(flat))] - 1] = False
    return _word_ids(flat), starts, inside


class Counts:
    """Counts by key. `total` is their sum over the corpus, where only some of its keys are held."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, total: int | None = None):
        order = np.argsort(keys)
        self.keys, self.n = keys[order], n[order]
        self.total = int(n.sum()) if total is None else total

    def sum(self) -> int:
        return self.total

    def max(self) -> int:
        return int(self.n.max(initial=0))

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Count of each key, 0 for unknown ones."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.n[at], 0)


def _block_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of words and neighbouring pairs with their counts; the number of words under TOTAL."""
    keys, counts, total = [], [], 0
    for at in range(0, len(texts), SLICE):
        ids, _, inside = _flat(texts[at : at + SLICE])
        if len(ids):
            a, b = _keys(ids)
            k, n = np.unique(np.concatenate([a, b[inside]]), return_counts=True)
            keys.append(k)
            counts.append(n)
            total += len(ids)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k, where = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.zeros(len(k), np.int64)
    np.add.at(n, where, np.concatenate(counts))
    return np.append(k, TOTAL), np.append(n, total)


def _split(keys: np.ndarray, n: np.ndarray) -> tuple[Counts, Counts]:
    """Counts of words and of pairs from rows with TOTAL."""
    words, pairs = keys % 2 == 0, (keys % 2 == 1) & (keys != TOTAL)
    return Counts(keys[words], n[words], int(n[keys == TOTAL].sum())), Counts(keys[pairs], n[pairs])


def corpus_counts(docs: DataFrame, text: str = "text") -> tuple[Counts, Counts]:
    """Counts of all words and neighbouring pairs of all texts, collected: for a look at corpora that one machine can hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(dict(zip(("key", "n"), _block_counts(batch["t"].tolist()), strict=True)))

    parts = spread(docs.select(F.col(text).alias("t"))).mapInPandas(run, "key long, n long")
    rows = parts.groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    return _split(rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))


class Judge:
    """Scores texts against corpus counts."""

    def __init__(self, words: Counts, pairs: Counts):
        self.words, self.pairs = words, pairs
        self.total = max(1, words.sum())

    def pmi(self, ids: np.ndarray) -> np.ndarray:
        """PMI of each neighbouring pair; pairs that the corpus lacks count as seen half a time."""
        a, b = _keys(ids)
        logs = np.log(np.maximum(self.words.of(a), 1))
        return np.log(np.maximum(self.pairs.of(b), 0.5)) + np.log(self.total) - logs[:-1] - logs[1:]

    def scores(self, texts: list[str | None]) -> list[tuple[int, float, float, float]]:
        """Words, mean PMI, share of words in spam units, largest share of a unit's words that repeated pairs cover.

        Every text of at least LEAST_WORDS words is judged by unit, all units of all texts at once; shorter ones get the
        shares 0.
        """
        flat: list[str] = []
        sizes, doc, links, alone, goods, ends = [], [], [], [], [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            marked = with_links(t)
            linked = LINK in marked or LINK_END in marked
            priced = any(c in marked for c in "#£$€¥₹%") or "sku" in marked.lower()
            for u in _UNIT.split(marked):
                ws = _WORD.findall(u.lower()) if u else []
                if ws:
                    flat += ws
                    sizes.append(len(ws))
                    doc.append(i)
                    k = u.count(LINK) if linked else 0
                    links.append(k + u.count(LINK_END) if linked else 0)
                    alone.append(k == len(ws))
                    goods.append(len(_GOODS.findall(u)) if priced else 0)
                    ends.append(_END.search(u) is not None)
        if len(flat) < 2:
            return [(doc.count(i), 0.0, 0.0, 0.0) for i in range(len(texts))]
        size, of, links, alone, goods, ended = np.array(sizes), np.array(doc), np.array(links), np.array(alone), np.array(goods), np.array(ends)
        ids = _word_ids(flat)
        n = np.bincount(of, size, len(texts)).astype(np.int64)
        unit = np.repeat(np.arange(len(size)), size)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        inside, together = unit[1:] == unit[:-1], of[unit[1:]] == of[unit[:-1]]
        pmi = np.append(np.where(together, self.pmi(ids), 0.0), 0.0)
        mean = np.bincount(of[unit], pmi, len(texts)) / np.maximum(n - 1, 1)
        coherent = np.add.reduceat(np.append(np.where(inside, pmi[:-1], 0.0), 0.0), start) / np.maximum(size - 1, 1)
        within, across = _times(ids, unit), _times(ids, of[unit])

        def covered(pairs: np.ndarray) -> np.ndarray:
            words = np.zeros(len(ids), np.int64)
            words[:-1] |= pairs & inside
            words[1:] |= pairs & inside
            return np.add.reduceat(words, start) / size

        stuffed = np.where(size >= 6, covered(within >= STUFFED_TIMES), 0.0)
        bad = (size >= SALAD_WORDS) & (coherent < SALAD_PMI) | (size >= SHORT_SALAD_WORDS) & (coherent < SHORT_SALAD_PMI)
        bad |= (size >= 8) & (stuffed >= np.where(ended, STUFFED_SHARE, STUFFED_OPEN_SHARE))
        bad |= alone | ~ended & (links > 0) & (size <= MARK_WORDS * links)
        bad |= ~ended & (goods > 0) & (size <= MARK_WORDS * goods)
        bad |= ~ended & (size > 1) & (size <= MARK_WORDS) & (covered(across >= 2) >= 0.99) & (covered(across >= 4) >= 0.6)
        spam = np.bincount(of, size * bad, len(texts)) / np.maximum(n, 1)
        most = np.zeros(len(texts))
        np.maximum.at(most, of, stuffed)
        judged = n >= LEAST_WORDS
        return list(zip(n.tolist(), mean.tolist(), (spam * judged).tolist(), (most * judged).tolist(), strict=True))

    def score(self, text: str | None) -> tuple[int, float, float, float]:
        return self.scores([text])[0]


def _times(ids: np.ndarray, group: np.ndarray) -> np.ndarray:
    """How often each neighbouring pair occurs in the group of its first word."""
    key = _keys(ids)[1]
    g = group[:-1]
    order = np.lexsort((key, g))
    k, h = key[order], g[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])])
    runs = np.diff(np.append(np.flatnonzero(new), len(k)))
    out = np.empty(len(k), np.int64)
    out[order] = np.repeat(runs, runs)
    return out


def spam_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, words, mean_pmi, spam_share, stuffed_share and is_spam of every row.

    Null, empty and very short texts are no spam. Texts are shuffled once, by a hash of row and text, so hot sources do no
    harm; nothing is broadcast. A block sends each of its distinct keys once, so that a frequent pair has no more rows
    than there are blocks. Repeated rows get the same scores.
    """
    c = F.col
    parts = shuffle_partitions(ready(docs.sparkSession))
    rows = docs.select(c(key).cast("string").alias("k"), c(text).alias("t"))  # as strings, large ids survive beside nulls
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("k", "t"), F.lit(max(2 * parts, chars // BLOCK_CHARS)))).repartition(parts, "block")

    def count(block: tuple, group: pd.DataFrame) -> pd.DataFrame:
        keys, n = _block_counts(group["t"].tolist())
        return pd.DataFrame({"block": np.full(len(keys), block[0]), "key": keys, "n": n})

    def score(_: tuple, group: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        judge = Judge(*_split(counts["key"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)))
        texts = group["t"].tolist()
        found = [r for at in range(0, len(texts), SLICE) for r in judge.scores(texts[at : at + SLICE])]
        out = pd.DataFrame(found, columns=["words", "mean_pmi", "spam_share", "stuffed_share"])
        out.insert(0, "k", group["k"].to_numpy())
        return out

    own = blocks.groupBy("block").applyInPandas(count, "block long, key long, n long").repartition(parts, "key")
    counted = own.select("block", "key", F.sum("n").over(Window.partitionBy("key")).alias("n")).repartition(parts, "block")
    out = blocks.groupBy("block").cogroup(counted.groupBy("block")).applyInPandas(score, "k string, words long, mean_pmi double, spam_share double, stuffed_share double")
    spam = (c("spam_share") > SPAM_SHARE) & (c("words") >= LEAST_WORDS)
    return out.select(c("k").cast(docs.schema[key].dataType).alias(key), "words", "mean_pmi", "spam_share", "stuffed_share", spam.alias("is_spam"))
