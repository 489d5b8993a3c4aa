"""Encoding whole texts with a public tokenizer, by remembered parts cut at safe boundaries.

A byte-level BPE without normaliser cuts a text into pieces before it merges. Such a piece is a run of
letters, of digits, of other signs or of white space, the first three perhaps behind one space. So a
piece always starts at a space before a character that is no white space, at a line end behind one,
and at a punctuation mark behind a letter or digit: there a text may be cut, and equal parts have equal
ids wherever they stand. A text is split at spaces and each part is looked up; one that isn't known is cut
further, and what is still unknown goes to the model, or to the library if it isn't one piece. Words are
remembered, words with their marks aren't: those are made of what is remembered. A run of letters that nothing interrupts is one piece
however long it is. The strings of special tokens are cut out first. Tokenizers of any other kind get
whole texts.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

#: Bytes, about, of the parts that a worker remembers; beyond this it starts afresh. Longer parts than
#: LONG characters are forgotten with their group.
HELD_BYTES, LONG = 96 << 20, 64
_CUT = re.compile(r" (?=\S)")
#: Further cuts: before a line end and behind a single one, around marks.
_FINER = re.compile(r"(?<=\S)(?=\n)|(?<=\S\n)(?=\S)|(?<=[^\W_])(?=[.,;:!?\u2026\u3001\u3002\uff0c\uff01\uff1f\uff1b\uff1a\u300c\u300d\uff08\uff09])|(?<=[.,;:!?])(?=[A-Za-z0-9])")
_MARKS = ".,;:!?"
#: One piece: the pre-tokenizer leaves it whole, so the model takes it at once.
_PIECE = re.compile(" ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]+|[.,;:!?]+)|\n")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level models write for each byte: visible Latin-1 characters stand for
    themselves, the other bytes in turn for the characters from 256 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b != 32]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


_BYTES = _byte_letters()
_loaded: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """One encoder for each file and worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[path] = Encoder(path)
    return _loaded[path]


class Unsafe(Exception):
    """A space before white space: no text may be cut there."""


class Parts(dict):
    """The ids of lead + key, for the keys that were asked for."""

    def __init__(self, encoder: "Encoder", lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead

    def __missing__(self, key: str) -> bytes:
        return self.encoder.learn(self, key)


class Encoder:
    def __init__(self, path: str):
        self.sp = self.lib = None
        self.splits = False
        if path.endswith(".model"):
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made.get("pre_tokenizer") or {}
        self.splits = (
            not made.get("normalizer")
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
        )
        special = {t["content"]: t for t in made.get("added_tokens", [])}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.splits = self.splits and not any(t.get(k) for t in special.values() for k in ("lstrip", "rstrip", "single_word"))
        #: Parts behind a space, by what follows it, and other parts.
        self.ids, self.bare = Parts(self, " "), Parts(self, "")
        self.fixed = {text: self._bytes([t["id"]]) for text, t in special.items()}
        self.held = 0

    def whole(self, texts: list[str]) -> list[list[int]]:
        if self.sp is not None:
            return self.sp.encode(texts, num_threads=1)
        return [e.ids for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def parts(self, text: str) -> list[str]:
        """The text, cut at safe boundaries."""
        if self.special is not None and self.special.search(text):
            return [p for k, x in enumerate(self.special.split(text)) if x for p in ([x] if k % 2 else self.parts(x))]
        head, *rest = _CUT.split(text)
        return [head, *[" " + x for x in rest]] if head else [" " + x for x in rest]

    def learn(self, memo: Parts, key: str) -> bytes:
        """The ids of a part that isn't remembered."""
        if memo.lead and (not key or key[0].isspace()):
            raise Unsafe
        if not memo.lead and key in self.fixed:
            return self.fixed[key]
        word = key.rstrip(_MARKS)
        if len(word) < len(key) and word[-1:].isalnum():
            return memo[word] + self.bare[key[len(word) :]]
        part = memo.lead + key
        if key.isascii() and key.isalpha():
            ids = self._word(part)
        elif _PIECE.fullmatch(part):
            ids = self._word(part)
        else:
            first, *rest = _FINER.split(part)
            if rest:
                return b"".join([memo[first[len(memo.lead) :]], *map(self.bare.__getitem__, rest)])
            ids = self._bytes(self.lib.encode(part, add_special_tokens=False).ids)
        if len(part) <= LONG:
            if self.held > HELD_BYTES:
                self.ids.clear()
                self.bare.clear()
                self.held = 0
            memo[key] = ids
            self.held += 4 * len(key) + len(ids) + 160  # both objects and their place in the dictionary
        return ids

    def _word(self, part: str) -> bytes:
        letters = part.replace(" ", _BYTES[32]) if part.isascii() and part != "\n" else part.encode().decode("latin-1").translate(_BYTES)
        return self._bytes([t.id for t in self.lib.model.tokenize(letters)])

    def _found(self, text: str | None) -> list[bytes]:
        """The ids of a text's parts in order."""
        if not text:
            return []
        if self.special is None or not self.special.search(text):
            head, *rest = text.split(" ")
            try:
                return [self.bare[head] if head else b"", *map(self.ids.__getitem__, rest)]
            except Unsafe:
                pass
        return [self.ids[p[1:]] if p[0] == " " and p[1:] and not p[1].isspace() else self.bare[p] for p in self.parts(text)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as unsigned 32-bit little-endian integers."""
        return [b"".join(self._found(t)) for t in texts] if self.splits else [self._bytes(x) for x in self.whole([t or "" for t in texts])]

    def lengths(self, texts: list[str | None]) -> list[int]:
        """How many ids each text has; they aren't put together."""
        return [sum(map(len, self._found(t))) // 4 for t in texts] if self.splits else list(map(len, self.whole([t or "" for t in texts])))

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        made = array("I", ids)
        if sys.byteorder == "big":
            made.byteswap()
        return made.tobytes()
