"""Byte-level BPE encoding of whole corpora (problem 7).

Every text is cut into pieces that no merge crosses, and each piece is merged by a segment tree: its leaves hold, for
every byte position that starts a live part, the rank of the pair formed with the next part; every inner node holds the
least rank below it, the leftmost on ties. The root is the next merge, and a merge changes three leaves, so a piece of n
bytes takes O(n log n) however long it is.
"""

from __future__ import annotations

import base64
import functools
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import spread

#: White space as Unicode's White_Space property has it (str.isspace() has four more).
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces kept per worker; then the cache starts anew.
CACHE = 400_000
#: Rows per Arrow batch that goes back to the JVM.
SLICE = 2_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _ranges(wanted: str) -> str:
    """A character class body of all code points whose general category starts with one of `wanted`."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] in wanted
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@functools.lru_cache(1)
def piece_pattern() -> re.Pattern:
    """The vocabulary's cutting rule: English endings, letters, numbers, other signs, white space."""
    letters, numbers = _ranges("L"), _ranges("N")
    return re.compile(
        f"'(?:[sdmt]|ll|ve|re)| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACES}{letters}{numbers}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
    )


_ODD_SPACE = re.compile(f" [{SPACES}]")
_CHUNK_START = re.compile(f"(?= [^{SPACES}])")


def chunks(text: str) -> list[str]:
    """Cut before every plain space that a sign follows: no piece crosses such a place, so chunks encode on their own."""
    if _ODD_SPACE.search(text) or text[-1:] == " ":
        return [c for c in _CHUNK_START.split(text) if c]
    first, *rest = text.split(" ")
    return [first, *[" " + c for c in rest]] if first else [" " + c for c in rest]


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece; the pair of least rank merges first, the leftmost on ties."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    bits = n.bit_length()
    mask, none = (1 << bits) - 1, 1 << 62
    size = 1 << (n - 1).bit_length()
    get = ranks.get
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    tree = [none] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << bits | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    def rank_at(i: int) -> int:
        j = after[i]
        if j >= n:
            return none
        r = get(piece[i : after[j]])
        return none if r is None else r << bits | i

    while (top := tree[1]) != none:
        i = top & mask
        j = after[i]
        k = after[i] = after[j]
        if k < n:
            before[k] = i
        put(j, none)
        put(i, rank_at(i))
        if (p := before[i]) >= 0:
            put(p, rank_at(p))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Encodes texts by one vocabulary and keeps the ids of chunks that come back."""

    def __init__(self, path: str):
        self.ranks, self.pieces, self.cache = load_ranks(path), piece_pattern(), {}

    def chunk(self, text: str) -> tuple[int, ...]:
        ids: list[int] = []
        for piece in self.pieces.findall(text):
            ids += merge_piece(piece.encode("utf-8", "surrogatepass"), self.ranks)
        if len(self.cache) >= CACHE:
            self.cache.clear()
        if len(text) <= 64:
            self.cache[text] = tuple(ids)
        return tuple(ids)

    def encode(self, text: str | None, into: array | None = None) -> array:
        ids = array("i") if into is None else into
        if text:
            get, extend = self.cache.get, ids.extend
            for c in chunks(text):
                extend(get(c) or self.chunk(c))
        return ids


@functools.lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_column(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """`key` and `ids` (array<int>) of every row, without special tokens; one narrow pass, no shuffle.

    Null and empty texts give an empty list. Texts of any length, repeated rows and other columns are no matter: a row in
    gives a row out. `vocabulary` is the path of a rank file on the driver, which is sent to executors that lack it; strings
    of special tokens in a text are ordinary text.
    """
    path = vocabulary or default_vocabulary()
    docs.sparkSession.sparkContext.addFile(path)
    rows = spread(docs.select(F.col(key).alias("k"), F.col(text).alias("t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids, offsets = array("i"), np.zeros(part.num_rows + 1, np.int32)
                for i, t in enumerate(part.column(1).to_pylist(), 1):
                    enc.encode(t, ids)
                    offsets[i] = len(ids)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["k", "ids"])

    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, ids array<int>").select(F.col("k").alias(key), "ids")


