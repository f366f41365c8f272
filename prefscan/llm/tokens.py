"""Token ids of whole texts with the ``tokenizers`` library.

A byte-level vocabulary splits texts at every single space, and inside these
pieces by a fixed pattern, before it merges bytes; so the ids of ``a b c`` are
those of ``a``, `` b`` and `` c`` in a row.  Corpora repeat their words, so an
encoder keeps the ids of the pieces and words it has met (at most
``PIECES`` and ``WORDS``; a full cache starts anew) and asks the library's model only for new
words.  A step sends its encoder as a broadcast: each worker opens its own, keeps it
from task to task, and Spark drops it with all it holds (some 400 MB when full) when
the worker turns to another step.  Texts with runs of spaces or added tokens, and other kinds of
vocabulary, go to the tokenizer whole.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import public_tokenizers
import regex

PIECES, WORDS = 2_200_000, 200_000
_ENDS = frozenset(",.;:!?")

# fixed values of byte-level vocabularies: the split pattern, and the bytes that stand for themselves
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OWN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]


def default_tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, int]:
    """The letter of each byte; the others follow from 256 on."""
    rest = [b for b in range(256) if b not in set(OWN_BYTES)]
    return {b: b for b in OWN_BYTES} | {b: 256 + i for i, b in enumerate(rest)}


class _Words(dict):
    """Ids by split piece, asked of the model where they are missing."""

    def __init__(self, model, letters: dict[int, int], kind: str):
        super().__init__()
        self.tokenize, self.letters, self.kind = model.tokenize, letters, kind

    def ids(self, letters: str) -> bytes:
        return array(self.kind, [t.id for t in self.tokenize(letters)]).tobytes()

    def spell(self, word: str) -> str:
        return word.encode("utf-8").decode("latin-1").translate(self.letters)

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.ids(self.spell(word))
        return found


class _Pieces(dict):
    """Ids by piece, without the space before it.  A word is a piece of its own, so
    one with a sign behind it costs no second call of the model."""

    def __init__(self, words: _Words, split):
        super().__init__()
        self.words, self.split = words, split

    def __missing__(self, piece: str) -> bytes:
        words = self.words
        if piece.isalpha():
            found = words.ids("\u0120" + (piece if piece.isascii() else words.spell(piece)))
        elif piece[-1:] in _ENDS and piece[:-1].isalpha():
            found = self[piece[:-1]] + words[piece[-1]]
        else:
            found = b"".join([self[w[1:]] if w[0] == " " and w[1:].isalpha() else words[w]
                              for w in self.split(" " + piece)])
        self[piece] = found
        return found


class Encoder:
    """``encode(texts)``: little-endian ids of each text as bytes, 2 or 4 an id.
    Pickled as its path: whoever receives it starts with empty caches."""

    def __init__(self, path: str):
        self.path = path
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.width = 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_word = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                        and not pre.get("add_prefix_space") and not spec.get("normalizer")
                        and spec["model"]["type"] == "BPE")
        self.split = regex.compile(PATTERN).findall
        self.letters = byte_letters()
        self.words = _Words(self.tok.model, self.letters, "H" if self.width == 2 else "I")
        self.pieces = _Pieces(self.words, self.split)

    def __reduce__(self):
        return Encoder, (self.path,)

    def _whole(self, texts: list[str]) -> list[bytes]:
        kind = f"<u{self.width}"
        return [np.array(e.ids, dtype=kind).tobytes()
                for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for text in texts:
            if not self.by_word or "  " in text or text.endswith(" ") or any(a in text for a in self.added):
                out += self._whole([text])
                continue
            head, *rest = text.split(" ")
            out.append(b"".join(map(self.words.__getitem__, self.split(head)))
                       + b"".join(map(self.pieces.__getitem__, rest)))
            if len(self.pieces) > PIECES:
                self.pieces.clear()
            if len(self.words) > WORDS:
                self.words.clear()
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The driver's encoder of a vocabulary, to be sent as a broadcast."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
