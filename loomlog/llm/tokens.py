"""Encoding of whole texts with a public byte-level BPE tokenizer (problem 8).

A text is encoded as a monoid reduction: halves are encoded on their own, and
neighbours are joined by encoding a window around the seam anew. The window
starts at a word start of the left half that no later character can move, and
grows to the right until the words found from there meet a word start of the
right half; from there both agree, so the tokens outside the window stand.

Cases and their results:
- null and empty texts: the empty list of ids;
- special tokens are ordinary text; texts of any length are encoded whole;
- the path of the vocabulary is a parameter, by default that of the installed
  package of public tokenizers.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: characters that are encoded in one piece; longer texts are halved
LEAF = 8192
#: A word start is settled if this many characters follow it within the half: a contraction looks at most two ahead.
LOOKAHEAD = 4


class Encoder:
    """The ids of texts by one vocabulary; leaf as in LEAF."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.words = regex.compile(pattern)
        self.leaf = max(leaf, 4 * LOOKAHEAD)

    def _plain(self, text: str) -> list[int]:
        return self.bpe.encode_ordinary(text)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return self._plain(text) if len(text) <= self.leaf else self._reduce(text, 0, len(text))[0]

    def _reduce(self, text: str, a: int, b: int) -> tuple[list[int], int]:
        """The ids of text[a:b] and its last settled word start."""
        if b - a <= self.leaf:
            return self._plain(text[a:b]), self._settled(text, a, b)
        mid = (a + b) // 2
        left, anchor = self._reduce(text, a, mid)
        right, end = self._reduce(text, mid, b)
        found, right_words = self.words.finditer(text, anchor, b), self.words.finditer(text, mid, b)
        p, q, window, dropped = anchor, mid, [], 0
        while p != q:  # both runs move on until they start a word at the same place; at the latest at the end
            # words are encoded one by one, as white space at the end of a piece is another word than before a letter
            if p < q:
                start, p = p, next((m.end() for m in found), b)
                window += self._plain(text[start:p])
            else:
                start, q = q, next((m.end() for m in right_words), b)
                dropped += len(self._plain(text[start:q]))
        head = left[: len(left) - len(self._plain(text[anchor:mid]))]
        tail = right[dropped:]
        # right of the meeting point both halves agree; if its last settled start lies before that, the window's run goes on
        return head + window + tail, end if end >= p else anchor if p >= b - LOOKAHEAD else p

    def _settled(self, text: str, a: int, b: int) -> int:
        last = a
        for m in self.words.finditer(text, a, b):
            if m.end() > b - LOOKAHEAD:
                break
            last = m.end()
        return last


@functools.cache
def encoder(path: str | None = None, leaf: int = LEAF) -> Encoder:
    """One encoder per Python worker."""
    import public_tokenizers as P

    return Encoder(path or P.path("byte_bpe_50k.tiktoken"), P.PATTERN, leaf)


def _list_array(ids: list[list[int]]) -> pa.ListArray:
    offsets = np.zeros(len(ids) + 1, "int32")
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.fromiter((i for x in ids for i in x), "int32", offsets[-1])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _batches(batches: Iterator[pa.RecordBatch], path: str | None, counts: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            ids = [enc.encode(t) for t in part.column(1).to_pylist()]
            out = pa.array([len(x) for x in ids], pa.int32()) if counts else _list_array(ids)
            yield pa.RecordBatch.from_arrays([part.column(0), out], names=["doc_id", "n_tokens" if counts else "ids"])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row of docs (doc_id bigint, text)."""
    return docs.select("doc_id", "text").mapInArrow(lambda it: _batches(it, path, False), "doc_id bigint, ids array<int>")


def count(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row of docs; the ids never leave the Python worker."""
    return docs.select("doc_id", "text").mapInArrow(lambda it: _batches(it, path, True), "doc_id bigint, n_tokens int")
