import random

import pytest
from tokenizers import Tokenizer

from scriptorium.llm import encode

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = ["", None, " ", "  a", "a  ", "a \n b", "a  \n\n  b  c\x85 \x1c x", "it's we'll <|endoftext|> x", "x" * 3000 + "ab" * 2000, "　第三 　 ", "½ x² Ⅷ\t\t t", "नमस्ते दुनिया", "﻿A​B", "naïve café", "1234567890" * 5, "\n" * 50, "日本語のテキスト" * 40]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch([y or "" for y in texts], add_special_tokens=False)]


def test_same_ids_as_the_public_library(spark, reference):
    r = random.Random(1)
    made = ["".join(r.choice("ab \n\t'sé第ñ!?.,<9 ") for _ in range(r.randint(0, 80))) for _ in range(300)]
    texts = TEXTS + made
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = encode.encode_column(df.select("doc_id", "text", "ids")).collect()
    got = {x["doc_id"]: list(x["ids"]) for x in rows}
    assert len(got) == len(texts)
    for i, want in enumerate(reference(texts)):
        assert got[i] == want, texts[i]


def test_merges_by_the_tree_equal_plain_merges():
    ranks = encode.load_ranks(encode.default_vocabulary())

    def plain(piece):
        parts = [bytes([b]) for b in piece]
        while True:
            best = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                return [ranks[p] for p in parts]
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    r = random.Random(2)
    for _ in range(200):
        piece = "".join(r.choice("abcdefgh etanoi") for _ in range(r.randint(1, 60))).encode()
        assert encode.merge_piece(piece, ranks) == ([ranks[piece]] if piece in ranks else plain(piece))


def test_an_empty_table(spark):
    assert encode.encode_column(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_keys_and_repeats_stay(spark):
    rows = encode.encode_column(spark.createDataFrame([(None, "a"), (2**60 + 1, "a"), (2**60 + 1, "a")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0) for r in rows) == [0, 2**60 + 1, 2**60 + 1]
