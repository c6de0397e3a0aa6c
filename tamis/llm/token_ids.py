"""Token ids of whole texts by a public tokenizer file."""

from __future__ import annotations

import json
import re
from array import array

from tamis.llm.tables import kept_in_worker

# Letters that normalisation only lower-cases, then ASCII punctuation, which is a token run of its own.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
# str.split() takes these for white space, the tokenizers library does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_WORD_NORMALIZER = ["NFC", "Replace", "Lowercase"]


def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: itself where
    printable, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return {b: chr(b if b in shown else next(other)) for b in range(256)}


class Encoder(dict):
    """Ids of a text as little-endian unsigned 32-bit integers, without special
    tokens. A vocabulary that drops white space is encoded piece by piece
    between spaces: the dict keeps the ids of the first ``keep`` pieces, and
    ``words`` those of three times as many words in lower case; the others are encoded
    each time."""

    def __init__(self, path: str, keep: int = 200_000):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.words: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.model, self.keep = self.whole.model, keep
        self.letters = byte_letters()
        steps = [x.get("type") for x in (spec["normalizer"] or {}).get("normalizers", [])]
        split = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.by_word = steps == _WORD_NORMALIZER and split.get("behavior") == "Removed"

    def slow(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, letters: str) -> bytes:
        ids = self.words.get(letters)
        if ids is None:
            shown = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [x.id for x in self.model.tokenize(shown)]).tobytes()
            if len(self.words) < 3 * self.keep:
                self.words[letters] = ids
        return ids

    def __missing__(self, piece: str) -> bytes:
        plain = _PLAIN.fullmatch(piece)
        if plain is None:
            ids = self.slow(piece)
        else:
            letters, marks = plain.groups()
            ids = self.word(letters.lower())
            if marks:
                ids += self[marks]
        if len(self) < self.keep:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self.slow(text)
        pieces = text.split(" ") if _NOT_SPACE.search(text) else text.split()
        return b"".join(map(self.__getitem__, pieces))


def encoder(path: str) -> Encoder:
    """One per Python worker, as long as its tasks encode."""
    return kept_in_worker(("encoder", path), lambda: Encoder(path))
