"""Token ids of whole texts through the tokenizers library, inside Arrow tasks.

Most pieces of a text between blanks occur again and again, so each distinct piece is encoded once per worker and looked
up afterwards. The cuts are made where neither pre-tokenizer ever joins two characters, which keeps the ids equal to
those of the whole text; a text without such cuts is encoded whole.
"""

from __future__ import annotations

import gc
import itertools
import os
from collections.abc import Iterable

import numpy as np

#: Distinct pieces that a worker remembers; beyond them it forgets the rarer half.
REMEMBERED = 600_000
#: Marks that both pre-tokenizers cut from a letter before them.
MARKS = (".", ",", ";", ":", "!", "?")
#: Letters below this are Latin and single characters in normal form.
LATIN_END = "\u0250"
#: How byte-level vocabularies write a byte: printable ones as they are, the rest as the characters from 256 on, in order.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}

_ENCODERS: dict[tuple[str, bool], Encoder] = {}


class _Index(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Encoder:
    """``spaced``: the blank before a word belongs to it (byte-level vocabularies); else blanks are dropped."""

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced = Tokenizer.from_file(path), spaced
        self.model = self.tokenizer.model
        self.forget()

    def forget(self) -> None:
        self.index = _Index()
        self.known = 0
        self.pool = np.empty(1 << 20, np.uint32)
        self.starts = np.zeros(1, np.int64)
        self.hits = np.zeros(0, np.int64)

    def forget_rare(self) -> None:
        """Keeps the half of the pieces that were asked for most."""
        kept = np.sort(np.argsort(-self.hits, kind="stable")[: REMEMBERED // 2])
        length = np.diff(self.starts)[kept]
        ahead = np.cumsum(length) - length
        self.pool = self.pool[np.repeat(self.starts[kept] - ahead, length) + np.arange(length.sum())]
        self.starts = np.concatenate([[0], np.cumsum(length)])
        stays = np.zeros(len(self.index), bool)
        stays[kept] = True
        names = list(itertools.compress(self.index, stays.tolist()))
        self.index.clear()
        self.index.update(zip(names, range(len(names)), strict=True))
        self.hits, self.known = self.hits[kept], len(names)

    def _pieces(self, text: str) -> list[str]:
        if not self.spaced:
            return text.replace("\n", " ").split(" ")
        if "  " in text or "\0" in text or text[-1:] == " ":
            return [text]
        return text.replace(" ", "\0 ").split("\0")

    def _parts(self, piece: str) -> list[str]:
        """Pieces whose ids, one after another, are those of the piece."""
        if self.spaced and "\n" in piece:
            first, *rest = lines = piece.split("\n")
            if len(lines) == 2 and rest[0] and first[-1:] not in ("", " ") and not first[-1].isspace() and not rest[0][0].isspace():
                return [*self._parts(first), "\n", *self._parts(rest[0])]
            return [piece]
        stem, mark = (piece[:-1], piece[-1:]) if piece[-1:] in MARKS and piece[-2:-1].isalpha() else (piece, "")
        if not self.spaced and stem.isascii() and stem.isalpha():
            stem = stem.lower()
        return [stem, mark] if mark else [stem]

    def _ids(self, pieces: list[str]) -> list:
        """Pieces of plain Latin letters go to the model itself, as the pre-tokenizer would write them."""
        out, other, spaced, tokenize = [None] * len(pieces), [], self.spaced, self.model.tokenize
        for i, piece in enumerate(pieces):
            start = spaced and piece[:1] == " "
            word = piece[1:] if start else piece
            if word.isalpha() and (spaced or word.islower()):
                if not word.isascii():
                    if max(word) >= LATIN_END:
                        other.append(i)
                        continue
                    word = word.encode().decode("latin-1").translate(BYTES)
                out[i] = [t.id for t in tokenize("\u0120" + word if start else word)]
            else:
                other.append(i)
        for at in range(0, len(other), 1000):
            some = other[at : at + 1000]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([pieces[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def _learn(self) -> None:
        """Encodes the pieces that are new since the last call."""
        known, index = self.known, self.index
        new = list(itertools.islice(index, known, None))
        bare, made = [], []
        for i, piece in enumerate(new):
            parts = self._parts(piece)
            if parts[0] == piece:
                bare.append(i)
            else:
                made.append((i, [index[p] for p in parts]))
        bare += range(len(new), len(index) - known)
        new += itertools.islice(index, known + len(new), None)
        found: list = [None] * len(new)
        for i, ids in zip(bare, self._ids([new[i] for i in bare]), strict=True):
            found[i] = ids
        for i, ats in made:
            found[i] = [x for at in ats for x in self._known(at, found)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        end = self.starts[-1] + lengths.sum()
        while end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.starts[-1] : end] = np.fromiter(itertools.chain.from_iterable(found), np.uint32, lengths.sum())
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.known = len(index)

    def _known(self, at: int, found: list) -> list[int]:
        return found[at - self.known] if at >= self.known else self.pool[self.starts[at] : self.starts[at + 1]].tolist()

    def encode(self, texts: Iterable[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, ``end`` after each, in one array, and where each text begins in it."""
        if len(self.index) > REMEMBERED:
            self.forget_rare()
        # the many short lists made here hold no cycles; looking for some takes longer than the encoding
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts, end)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: Iterable[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        numbers, counts = [], []
        for text in texts:
            found = list(map(self.index.__getitem__, self._pieces(text or "")))
            numbers.append(np.array(found, np.int64))
            counts.append(len(found))
        self._learn()
        if not counts:
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        flat = np.concatenate(numbers)
        self.hits = np.bincount(flat, minlength=len(self.index)) + np.pad(self.hits, (0, len(self.index) - len(self.hits)))
        begin, length = self.starts[flat], np.diff(self.starts)[flat]
        of_text = np.add.reduceat(length, np.cumsum([0, *counts[:-1]]))  # no text is without a piece
        bounds = np.concatenate([[0], np.cumsum(of_text + 1)])
        out = np.full(bounds[-1], end, np.uint32)
        # every id's place in the pool: it counts on from the beginning of its piece
        ahead = np.cumsum(length) - length
        taken = self.pool[np.repeat(begin - ahead, length) + np.arange(length.sum())]
        free = np.ones(bounds[-1], bool)
        free[bounds[1:] - 1] = False
        out[free] = taken
        return out, bounds


def encoder(path: str, spaced: bool) -> Encoder:
    """The worker's encoder of this vocabulary."""
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = Encoder(path, spaced)
    return _ENCODERS[path, spaced]


def slices(texts: list, size: int = 4_000_000) -> Iterable[slice]:
    """Runs of texts of about ``size`` characters together; a longer text is alone."""
    begin = total = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > begin and total + n > size:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield slice(begin, len(texts))


def binary(flat: np.ndarray, bounds: np.ndarray):
    """An Arrow binary array of runs of ids, each as little-endian unsigned 32-bit integers."""
    import pyarrow as pa

    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [
        None, pa.py_buffer((bounds * 4).astype(np.int64)), pa.py_buffer(flat.astype("<u4").tobytes())]).cast(pa.binary())


