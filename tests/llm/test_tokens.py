"""p8: the tree reduction gives what encoding in one piece gives, whatever the size of a leaf."""

import random

import pytest

from loomlog.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")


def texts():
    rng = random.Random(8)
    parts = ["the quick brown fox", "don't we'll I'VE", "   \n\n\t ", "12345678", "日本語のテキスト。", "ภาษาไทย", "😀👩‍👩‍👧", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "!!!???...", "<|endoftext|>", "x" * 200, " ", "\r\n", "é́", "नमस्ते दुनिया", "مرحبا بالعالم", "'s't're", "  "]
    return ["", " ", "a", *["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(150)]]


@pytest.mark.parametrize("leaf", [16, 31, 200])
def test_any_leaf(leaf):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    small, whole = tokens.Encoder(path, pattern, leaf), tokens.Encoder(path, pattern)
    for t in texts():
        assert small.encode(t) == whole.bpe.encode_ordinary(t), t
        assert small.bpe.decode(small.encode(t)) == t


def test_table(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "hello world"), (5, "word " * 30_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(df).collect()}
    assert got[2] == got[3] == [] and got[1] == got[4] and len(got[1]) == 2
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.count(df).collect()} == {k: len(v) for k, v in got.items()}
    assert tokens.encode(df.limit(0)).count() == 0
