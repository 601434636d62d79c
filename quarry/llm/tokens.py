"""Token ids of whole texts by a public tokenizer, with the ids of repeated words remembered.

Byte-pair encoding works on one pre-token at a time, so the ids of a text are those of its
pre-tokens, in order. For texts of the code points listed in `SAFE` the pre-tokens are found with
the expressions below, and the library encodes each distinct one once per worker; any other text
goes through the library whole. Both give the library's ids.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np

# Classes of the code points up to U+017F and some punctuation beyond.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = "\t\n\r "
SAFE = re.compile("[^\t\n\r -~¡-įı-ſ‐-‧€]")

# The pre-token patterns of the two tokenizers, over SAFE texts.
PIECES = {
    "byte_bpe_50k.json": re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{LETTERS}{NUMBERS}{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"),
    "word_bpe_49k.json": re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+"),
}
#: Pieces that stay one pre-token when a space stands before them.
PLAIN = re.compile(f" ?[{LETTERS}]+")
LOWER_FIRST = {"word_bpe_49k.json"}
#: Distinct pre-tokens remembered per worker unless told otherwise, a bound on its memory; others are encoded each time.
REMEMBERED = 200_000
#: Marks by hash of pre-tokens met before, as most are met once only and need not be remembered.
MARKS = 1 << 22

#: Tokenizers whose pre-tokens reach the library's model as their UTF-8 bytes, a character each, with these spelt otherwise.
BYTES = {"byte_bpe_50k.json"}
SPELT = {b: 256 + n for n, b in enumerate([*range(33), *range(127, 161), 173])}
SPACE = chr(SPELT[ord(" ")])
_encoders: dict[tuple, Encoder] = {}


class Known(dict):
    """Ids of pre-tokens; what is looked up in vain by [] is None, and noted."""

    def __init__(self):
        self.missed: list[str] = []

    def __missing__(self, piece: str) -> None:
        self.missed.append(piece)


class Encoder:
    def __init__(self, path: str, remembered: int, at_once: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # texts that hold a special token's name go through the library whole
        special = sorted({re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()}, key=len, reverse=True)
        self.special = re.compile("|".join(special) or r"(?!)", re.I)
        same = os.path.commonprefix([t.content for t in self.tokenizer.get_added_tokens_decoder().values()])
        self.lead, self.remembered = re.match(r"\W*", same)[0], remembered  # looked for first, as it is quick
        name = path.rsplit("/", 1)[-1]
        self.pieces, self.lower, self.known = PIECES.get(name), name in LOWER_FIRST, Known()
        self.bytes = name in BYTES
        self.met = None if at_once else bytearray(MARKS)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], lead: str) -> list[bytes]:
        """Ids of words that the pre-tokenizer keeps whole, each behind `lead`, encoded together and told apart by their numbers."""
        out: list[bytes] = []
        for i in range(0, len(words), 2000):
            some = words[i : i + 2000]
            e = self.tokenizer.encode(lead.join(["", *some]), add_special_tokens=False)
            word, ids = np.asarray(e.word_ids, np.int64), np.asarray(e.ids, "<u4")
            cuts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1], [True]))) * 4
            raw = ids.tobytes()
            if len(cuts) != len(some) + 1:
                return self._library([lead + w for w in words])
            out += [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return out

    def _again(self, fresh: dict[str, bytes]) -> dict[str, bytes]:
        """Those met before; the others are marked."""
        marks = {p: hash(p) % MARKS for p in fresh}
        again = {p: fresh[p] for p, mark in marks.items() if self.met[mark]}
        for mark in marks.values():
            self.met[mark] = 1
        return again

    def _whole(self, text: str) -> bool:
        """If the library gets the text whole."""
        return bool(self.pieces is None or SAFE.search(text) or (self.lead in text and self.special.search(text)))

    def _fresh(self, new: set[str]) -> dict[str, bytes]:
        """Ids of new pre-tokens, remembered while there is room."""
        if self.bytes:
            tokenize = self.tokenizer.model.tokenize
            spelt = (p.replace(" ", SPACE) if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(SPELT) for p in new)
            return self._remember({p: array("I", [t.id for t in tokenize(x)]).tobytes() for p, x in zip(new, spelt)})
        plain = [p for p in new if PLAIN.fullmatch(p) and (p[0] == " ") != self.lower]
        other = list(new.difference(plain))
        fresh = dict(zip(plain, self._words([p if self.lower else p[1:] for p in plain], " ")))
        fresh.update(zip(other, self._library(other)))
        return self._remember(fresh)

    def _remember(self, fresh: dict[str, bytes]) -> dict[str, bytes]:
        if len(self.known) < self.remembered:
            self.known.update(fresh if self.met is None else self._again(fresh))
        return fresh

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self._whole(text):
            return self._library([text])[0]
        found = self.pieces.findall(text.lower() if self.lower else text)
        ids = list(map(self.known.__getitem__, found))
        if self.known.missed:
            new = set(self.known.missed)
            self.known.missed.clear()
            fresh = self._fresh(new)
            ids = [fresh[p] if i is None else i for p, i in zip(found, ids)]
        return b"".join(ids)


def encoder(path: str, remembered: int = REMEMBERED, at_once: bool = False) -> Encoder:
    """This worker's encoder; `at_once` remembers pre-tokens when they are met first, not again, for more memory and less work."""
    wanted = (path, remembered, at_once)
    if wanted not in _encoders:
        _encoders[wanted] = Encoder(*wanted)
    return _encoders[wanted]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
