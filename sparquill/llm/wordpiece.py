"""Numbers of greedy word pieces, by a longest-match automaton that never builds the pieces.

The vocabulary is a trie. Each node has a failure link and the number of pieces popped on taking
it: where no longer match goes on, the link leads to the node of what is left after those pieces.
A word so takes time linear in its length. Symbols are bytes; a word's last byte is a symbol of
its own, as in vocabularies that mark word ends.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .tokens import byte_chars

_END = 256
#: The tokenizer's pattern for words before the vocabulary applies (a fixed value).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def symbols(word: bytes) -> list[int]:
    return [*word[:-1], word[-1] + _END]


class PieceCounter:
    """The automaton of a vocabulary, given as symbol lists. Single symbols outside it count as one piece each."""

    def __init__(self, vocabulary: Iterable[list[int]]) -> None:
        self.go: dict[int, int] = {}
        parent, edge, final = [0], [0], [False]
        for token in [*([s] for s in range(2 * _END)), *vocabulary]:
            node = 0
            for s in token:
                key = node << 9 | s
                if key not in self.go:
                    self.go[key] = len(parent)
                    parent.append(node)
                    edge.append(s)
                    final.append(False)
                node = self.go[key]
            final[node] = True
        depth = [0] * len(parent)
        for v in range(1, len(parent)):
            depth[v] = depth[parent[v]] + 1
        self.link, self.popped = [-1] * len(parent), [0] * len(parent)
        for v in sorted(range(1, len(parent)), key=depth.__getitem__):
            if final[v]:
                self.link[v], self.popped[v] = 0, 1
                continue
            z, n = self.link[parent[v]], self.popped[parent[v]]
            while z >= 0 and (z << 9 | edge[v]) not in self.go:
                n += self.popped[z]
                z = self.link[z]
            # Every single symbol is a piece, so the root goes on with any symbol.
            self.link[v], self.popped[v] = self.go[z << 9 | edge[v]], n

    def count(self, word: bytes) -> int:
        node, n, go, link, popped = 0, 0, self.go, self.link, self.popped
        for s in symbols(word):
            while (after := go.get(node << 9 | s, -1)) < 0:
                n += popped[node]
                node = link[node]
            node = after
        while node:
            n += popped[node]
            node = link[node]
        return n


def vocabulary(path: str) -> list[list[int]]:
    """The symbol lists of a tokenizers file with byte-level characters and word ends."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    byte, end = {c: b for b, c in enumerate(byte_chars())}, model["end_of_word_suffix"]
    out = []
    for token in model["vocab"]:
        word = bytes(byte[c] for c in token.removesuffix(end))
        if word:
            out.append(symbols(word) if token.endswith(end) else list(word))
    return out


class TextCounter:
    """Numbers of words and pieces of texts; remembers up to limit white-space delimited strings."""

    def __init__(self, path: str, limit: int = 500_000) -> None:
        self.counter, self.limit = PieceCounter(vocabulary(path)), limit
        self.known: dict[bytes, tuple[int, int]] = {}

    def _string(self, s: bytes) -> tuple[int, int]:
        words = [w.encode() for w in WORDS.findall("".join(c.lower() for c in unicodedata.normalize("NFC", s.decode())))]
        return len(words), sum(map(self.counter.count, words))

    def count(self, text: bytes) -> tuple[int, int]:
        words = pieces = 0
        known = self.known
        for s in text.split():
            found = known.get(s)
            if found is None:
                if len(known) >= self.limit:
                    known.clear()
                found = known[s] = self._string(s)
            words += found[0]
            pieces += found[1]
        return words, pieces


_counters: dict[str, TextCounter] = {}


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_pieces for every row: greedy longest-match pieces of the whole text; 0 for null and empty texts.

    Repeated rows and null ids are counted like any other, an empty table has no rows, and further columns are not read.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = TextCounter(path)
        for batch in C.batches(it):
            counts = [_counters[path].count(t) for t in C.text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64())], ["doc_id", "n_words", "n_pieces"])

    rows = docs.select(C.quoted(id_col).cast("long").alias("doc_id"), C.quoted(text_col).cast("string").alias("text"))
    C.bound_batches(docs.sparkSession)
    return rows.mapInArrow(run, "doc_id long, n_words long, n_pieces long")
