"""Token ids of whole texts by a vocabulary file of ``tokenizers``, with a memory of seen words.

Byte-level pairs never join over a single white space character between other characters, so such
a text falls apart into words whose ids can be kept. Other texts go through the tokenizer whole, and
so do texts that hold the string of an added token, where such strings are tokens.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import regex

#: The splitting rule of byte-level vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Signs that end many words; a run of them after letters is a piece of its own.
_TAIL = ".,;:!?%&$#*|)\""

#: White space other than blank and line break.
_OTHER_SPACE = re.compile(r"[^\S \n]").search


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in such vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Encodes texts to little-endian 32-bit ids. ``memory`` bounds the words kept; when it is full all go.

    With ``added`` the strings of added tokens become those tokens, as the tokenizer has it by default;
    else those of special ones are ordinary text.
    """

    def __init__(self, path: str, memory: int = 500_000, added: bool = False):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = not added
        own = self.whole.get_added_tokens_decoder().values()
        self.added = [t.content for t in own if added or not t.special]
        self.model, self.letters, self.memory = self.whole.model, _byte_letters(), memory
        self.split = regex.compile(PIECES).findall
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= self.memory:
                self.pieces.clear()
            shown = piece.encode().decode("latin-1").translate(self.letters)
            ids = self.pieces[piece] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return ids

    def _word(self, word: str, glue: str) -> bytes:
        core = word.rstrip(_TAIL)
        if core.isalpha() and (core.isascii() or max(core) < "\u0250"):  # letters, then signs: no need for the full rule
            ids = self._piece(glue + core)
            return ids + self._piece(word[len(core) :]) if len(core) < len(word) else ids
        return b"".join(map(self._piece, self.split(glue + word)))

    def _joined(self, words: list[str]) -> bytes:
        known = self.words
        missing = set(words).difference(known)
        if missing:
            if len(known) + len(missing) > self.memory:
                known.clear()
                missing = set(words)
            for w in missing:
                # a word after a line break keeps the break, any other one gets its space back
                known[w] = self._word(w, "" if w[0] == "\n" else " ")
        return b"".join(map(known.__getitem__, words))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if text and _single(text) and not any(t in text for t in self.added):
                first, *rest = text.replace("\n", " \n").split(" ")
                yield self._word(first, "") + self._joined(rest)
            else:
                yield array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()


def _single(text: str) -> bool:
    """One blank or line break between words, no other white space anywhere."""
    return not (
        text[0] in " \n"
        or text[-1] in " \n"
        or "  " in text
        or " \n" in text
        or "\n " in text
        or "\n\n" in text
        or _OTHER_SPACE(text)
    )


@lru_cache(maxsize=1)
def encoder(path: str, added: bool = False) -> Encoder:
    """This process's encoder; its memory outlives a task."""
    return Encoder(path, added=added)
