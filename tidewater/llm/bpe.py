"""Byte-level BPE of whole texts by the tokenizers library, a distinct word at a time.

The pre-tokeniser never joins characters across a single space or line feed
between two characters that aren't white space.  A text is therefore cut there,
and every distinct cut is encoded once and kept; a text's ids are the joined
bytes of its cuts' ids.  Cuts are the same ids as the whole text's, which the
tests compare.
"""

from __future__ import annotations

import re
from array import array
from operator import attrgetter

#: Distinct cuts kept in each of two generations; the older one goes when the younger is full.
KEPT = 300_000
#: Cuts of more characters aren't kept.
LONGEST_KEPT = 64

#: Latin letters, and punctuation that is one pre-token after a word.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(rf"(\n?)([{_LETTERS}]+)([.,!?;:|#$%&*\-]*)")
_ID = attrgetter("id")
_CUT = re.compile(r"(?<=\S) (?=\S)")


class _Odd(Exception):
    """A cut that white space borders, so that the text must be cut with more care."""


def byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable bytes themselves, others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, more = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in shown else chr(more))
        more += b not in shown
    return out


class Encoder:
    """Texts to ids as bytes, little-endian unsigned 32-bit."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        if resize := getattr(self.model, "_resize_cache", None):  # no public name; without it words are kept twice
            resize(0)
        self.chars = byte_characters()
        self.space = self.chars[0x20]
        self.marks: dict[str, bytes] = {}
        self.line_feed = self._whole("\n")
        self.firsts: dict[str, bytes] = {}
        encoder = self

        class Cuts(dict):
            old: dict = {}

            def __missing__(self, cut: str) -> bytes:
                found = Cuts.old.get(cut)
                if found is None:
                    found = encoder._cut(cut)
                if len(cut) <= LONGEST_KEPT:
                    if len(self) >= KEPT:
                        Cuts.old = dict(self)
                        self.clear()
                    self[cut] = found
                return found

        self.cuts = Cuts()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _pre_token(self, text: str, space: str = "") -> bytes:
        """Ids of one pre-token, with a space before it or not, straight from the library's BPE model."""
        if not text.isascii():
            text = "".join(map(self.chars.__getitem__, text.encode()))
        return array("I", list(map(_ID, self.model.tokenize(space + text)))).tobytes()

    def _cut(self, cut: str) -> bytes:
        """Ids of a cut that began with a space, or with a line feed that it still has."""
        if (m := _PLAIN.fullmatch(cut)) is not None:
            line, word, marks = m.groups()
            if not marks:
                return self.line_feed + self._pre_token(word) if line else self._pre_token(word, self.space)
            end = self.marks.get(marks)
            if end is None:
                end = self._pre_token(marks)
                if len(self.marks) < KEPT // 10:
                    self.marks[marks] = end
            return self.cuts[line + word] + end
        inner = cut[1:] if cut[:1] == "\n" else cut
        if not inner or inner[0].isspace() or inner[-1].isspace():
            raise _Odd
        return self._whole(cut if cut[0] == "\n" else " " + cut)

    def _first(self, cut: str) -> bytes:
        found = self.firsts.get(cut)
        if found is None:
            if not cut or cut[0].isspace() or cut[-1].isspace():
                raise _Odd
            found = self._whole(cut)
            if len(self.firsts) >= KEPT // 4:
                self.firsts.clear()
            self.firsts[cut] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; a null one is empty."""
        if not text:
            return b""
        cuts = text.replace("\n", " \n").split(" ")
        try:
            return self._first(cuts[0]) + b"".join(map(self.cuts.__getitem__, cuts[1:]))
        except _Odd:
            return self._careful(text)

    def _careful(self, text: str) -> bytes:
        """As encode, for texts with runs of white space: only cut at single spaces between other characters."""
        first, *rest = _CUT.split(text)
        out = [self._whole(first)]
        for cut in rest:
            plain = _PLAIN.fullmatch(cut) is not None and cut[0] != "\n"
            out.append(self.cuts[cut] if plain else self._whole(" " + cut))
        return b"".join(out)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The process's encoder of a vocabulary file, by default the public byte-level one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
