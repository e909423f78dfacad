"""Token ids by a public tokenizer file, part by part through a bounded cache.

A tokenizer as that of word_bpe_49k.json (any other is refused) lower-cases, drops white space and never merges across it, nor
between an ASCII letter and an ASCII digit or mark other than an apostrophe, so a text's ids are
those of such parts, one after the other. Texts repeat most parts; the cache encodes each once.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterable

import numpy as np

from . import common as C

_OTHER = 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x21:0x7F] = 2
_CLASS[ord("a") : ord("z") + 1] = _CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("'")] = _OTHER
_CLASS[np.frombuffer(C.SPACE_BYTES, np.uint8)] = 0
#: Bytes of text looked up at a time; the working arrays take some forty times as much.
BLOCK = 1 << 18


def byte_chars() -> list[str]:
    """The character that a byte-level vocabulary writes for each byte: itself if printable, else one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in printable}
    for b in range(256):
        out.setdefault(b, chr(256 + len(out) - len(printable)))
    return [out[b] for b in range(256)]


def _parts(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts of a text."""
    c = _CLASS[a]
    before = np.concatenate((np.zeros(1, np.uint8), c[:-1]))
    begin = (c > 0) & ((before == 0) | (before * c == 2))
    stop = np.concatenate(((c[1:] == 0) | begin[1:], np.ones(1, bool))) & (c > 0)
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


class WordEncoder:
    """Ids of texts; holds at most limit parts between calls."""

    def __init__(self, path: str, limit: int = 1_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._check(path)
        self.model, self.chars, self.limit = self.tokenizer.model, byte_chars(), limit
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _check(self, path: str) -> None:
        """An error for a file whose tokenizer does not do what the parts rest on: lower case, parts removed at white space, words with ends."""
        own = json.loads(self.tokenizer.to_str())
        steps, cuts = ((x or {}).get(n, [x or {}]) for x, n in ((own["normalizer"], "normalizers"), (own["pre_tokenizer"], "pretokenizers")))
        lower = any(s.get("type") == "Lowercase" for s in steps)
        cut = any(c.get("type") == "Split" and c.get("behavior") == "Removed" and c.get("invert") for c in cuts)
        if not (lower and cut and own["model"].get("end_of_word_suffix")):
            raise ValueError(f"{path}: only tokenizers that lower-case and have word ends, cut at white space, can be encoded part by part")

    def _clear(self) -> None:
        self.keys, self.slots = np.zeros(0, C.U64), np.zeros(0, np.int64)
        self.starts, self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _encode(self, part: bytes) -> list[int]:
        """The ids of one part; parts that the tokenizer leaves in one piece go to its model directly."""
        if part.isascii():
            text = part.decode()
            plain = text.isalpha() or not any(ch.isalnum() or ch == "'" or ch < "!" or ch == "\x7f" for ch in text)
        else:
            text = unicodedata.normalize("NFC", part.decode())
            low = text.lower()
            plain = low.isalpha() and "Σ" not in text  # whose lower case in Python depends on its place
            if plain:
                text = "".join(self.chars[b] for b in low.encode())
        if plain:
            return [t.id for t in self.model.tokenize(text)]
        return self.tokenizer.encode(part.decode(), add_special_tokens=False).ids

    def _learn(self, hashes: np.ndarray, parts: list[bytes]) -> None:
        encoded = [self._encode(p) for p in parts]
        lengths = np.array([len(i) for i in encoded], np.int64)
        ids = np.fromiter((i for e in encoded for i in e), np.uint32, int(lengths.sum()))
        at = np.searchsorted(self.keys, hashes)
        self.keys = np.insert(self.keys, at, hashes)
        self.slots = np.insert(self.slots, at, len(self.starts) + np.arange(len(parts)))
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.flat = np.concatenate((self.flat, ids))

    def _block(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the parts of one lower-cased text, their numbers of ids, and all ids."""
        a = np.frombuffer(text, np.uint8)
        starts, ends = _parts(a)
        if not len(starts):
            return starts, starts, np.zeros(0, np.uint32)
        hashes, first, inverse = np.unique(C.span_hashes(a, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(hashes) > self.limit:
            self._clear()
        at = np.searchsorted(self.keys, hashes)
        new = np.ones(len(hashes), bool)
        new[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] != hashes[at < len(self.keys)]
        if new.any():
            self._learn(hashes[new], [text[starts[i] : ends[i]] for i in first[new].tolist()])
            at = np.searchsorted(self.keys, hashes)
        k = self.slots[at][inverse]
        n = self.lengths[k]
        stop = np.cumsum(n)
        take = np.repeat(self.starts[k] - stop + n, n)
        take += np.arange(len(take))
        return starts, n, self.flat[take]

    def encode(self, texts: Iterable[bytes]) -> list[np.ndarray]:
        """The ids of each UTF-8 text, as the tokenizer gives them without special tokens."""
        out: list[np.ndarray] = []
        held: list[bytes] = []
        size = 0

        def flush() -> None:
            starts, n, ids = self._block(b"\n".join(held))
            at = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in held)]))
            cut = np.concatenate(([0], np.cumsum(n)))[at]
            out.extend(ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))

        for t in texts:
            if held and size + len(t) > BLOCK:
                flush()
                held, size = [], 0
            if any(s in t for s in self.special):
                flush() if held else None
                held, size = [], 0
                out.append(np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, np.uint32))
            elif len(t) > BLOCK:
                out.append(np.concatenate([self._block(b.lower())[2] for b in C.blocks(t, BLOCK)]))
            else:
                held.append(t.lower())
                size += len(t) + 1
        if held:
            flush()
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def id_width(path: str) -> int:
    """Bytes that hold any id of the tokenizer."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4
