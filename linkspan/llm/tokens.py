"""Exact ids of whole texts from the tokenizers library, encoded piece by piece.

The pre-tokenizers of both vocabularies always cut at a blank between two other
characters, so the pieces between such blanks have ids that don't depend on their
neighbours: each distinct piece goes through the library once and is remembered.
Texts where a blank meets another blank are encoded by the library in stretches
that begin at such a cut, so the ids are those of the whole text in every case.
The same goes for texts with one of the vocabulary's special strings, which the
library turns into that string's own id wherever it stands.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are packed as little-endian 32-bit integers")

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces remembered in each of two generations; when the young one is full, it
#: becomes the old one, so frequent pieces stay and memory is bounded.
REMEMBERED = 500_000
LONG_PIECE = 64
STRETCH = 1 << 16
#: Characters that some version of some library takes for white space.
_ODD = "\u180e\u200b\ufeff"
_CUT = re.compile(rf"(?<=[^\s{_ODD}]) (?=[^\s{_ODD}])")


class _Irregular(Exception):
    pass


class _Pieces(dict):
    """Ids of pieces between blanks; a missing piece is encoded."""

    def __init__(self, encode, words, blanks_matter: bool):
        super().__init__()
        self.encode, self.words, self.blanks_matter = encode, words, blanks_matter
        self.old: dict[str, bytes] = {}
        self.marks = {mark: encode(mark) for mark in ".,"}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.fresh(piece)
        if len(piece) <= LONG_PIECE:
            self[piece] = ids
        return ids

    def fresh(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            return self.words(piece)
        if piece[-1:] in self.marks and (stem := piece[:-1]) and stem[-1].isascii() and stem[-1].isalpha():
            return self[stem] + self.marks[piece[-1]]  # the pre-tokenizers cut between a letter and a mark
        if not self.blanks_matter:
            return self.encode(piece) if piece else b""
        body = piece[1:] if piece[:1] == "\n" else piece
        if not body or any(c.isspace() or c in _ODD for c in (body[0], body[-1])):
            raise _Irregular
        return self.encode(piece if piece[0] == "\n" else " " + piece)

    def trim(self) -> None:
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()


class Encoder:
    """ids(text) as little-endian unsigned 32-bit integers; no special tokens are added.

    blanks_matter: whether white space is part of the ids (byte-level vocabularies)
    or dropped by the vocabulary's normaliser.
    """

    def __init__(self, name: str, blanks_matter: bool):
        import public_tokenizers
        from tokenizers import Tokenizer

        path = name if os.path.sep in name else public_tokenizers.path(name)
        tokenizer = Tokenizer.from_file(path)
        self.vocabulary = tokenizer.get_vocab_size()
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        model = tokenizer.model

        def encode(text: str) -> bytes:
            return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

        def words(word: str) -> bytes:
            """A run of ASCII letters is one pre-token, so the library's model takes it as it is."""
            return array("I", [t.id for t in model.tokenize("\u0120" + word if blanks_matter else word.lower())]).tobytes()

        self.encode, self.pieces, self.blanks_matter = encode, _Pieces(encode, words, blanks_matter), blanks_matter

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if any(mark in text for mark in self.special):
            return self._stretches(text)
        self.pieces.trim()
        if not self.blanks_matter:
            return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))
        pieces = text.replace("\n", " \n").split(" ")
        if not pieces[0] or pieces[0][0].isspace() or pieces[0][-1].isspace() or pieces[0][-1] in _ODD:
            return self._stretches(text)
        try:
            return self.encode(pieces[0]) + b"".join(map(self.pieces.__getitem__, pieces[1:]))
        except _Irregular:
            return self._stretches(text)

    def _stretches(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + STRETCH)
            to = cut.start() if cut else len(text)
            out.append(self.encode(text[at:to]))
            at = to
        return b"".join(out)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(name: str, blanks_matter: bool) -> Encoder:
    """The worker's own encoder, kept between batches and tasks."""
    key = (name, blanks_matter)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(name, blanks_matter)
    return _ENCODERS[key]
