"""Byte-level BPE ids for many texts at once.

Texts are cut into the pieces of the vocabulary's split pattern by numpy over
character classes, and each distinct piece is merged once and remembered. The
ids are those of ``tokenizers`` with the same vocabulary (tests compare them);
texts with characters beyond U+2FFF, whose classes depend on the library's
Unicode version, go through ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import mix64, powers, text_chunks, trim

_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
_LIMIT = 0x3000
_CLASS: list[np.ndarray] = []
#: White_Space of Unicode below U+3000 (fixed values).
_WHITE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F]


def _classes() -> np.ndarray:
    if not _CLASS:
        kinds = np.zeros(_LIMIT, dtype=np.uint8)
        for c in range(_LIMIT):
            kinds[c] = {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER)
        kinds[_WHITE] = _SPACE
        _CLASS.append(kinds)
    return _CLASS[0]


def pieces(points: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Starts of the pieces of consecutive texts (which start at ``texts``), as
    character offsets, by the pattern

    contractions | ' ?letters' | ' ?numbers' | ' ?others' | white space but its
    last character before a non-white one | white space
    """
    n = len(points)
    kind = _classes()[points]
    edge = np.ones(n, dtype=bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[texts] = True
    first = np.zeros(n + 1, dtype=bool)
    first[texts] = True
    start = edge.copy()
    runs = np.flatnonzero(edge)
    # the last white character before a run stands alone, or joins the run if it is a space
    after = runs[(kind[runs] != _SPACE) & ~first[runs]]
    after = after[kind[after - 1] == _SPACE]
    start[after - 1] = True
    start[after[points[after - 1] == 0x20]] = False
    quotes = runs[(points[runs] == 0x27) & start[runs]]
    quotes = quotes[quotes + 1 < n]
    for q in quotes[edge[quotes + 1] & (kind[quotes + 1] == _LETTER) & ~first[quotes + 1]].tolist():
        inside = q + 2 < n and not first[q + 2]
        two = chr(points[q + 1]) + (chr(points[q + 2]) if inside else "")
        length = 2 if two in ("re", "ve", "ll") else 1 if two[0] in "stmd" else 0
        if length:
            start[q + 1] = False
            if q + 1 + length < n and not first[q + 1 + length] and kind[q + 1 + length] == _LETTER:
                start[q + 1 + length] = True
    return np.flatnonzero(start)


_POINTS = mix64(np.arange(1, _LIMIT + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
_SLOTS = 1 << 20


class Bpe:
    """Ids below 65,536 as numpy arrays. ``name`` is a vocabulary of the public set;
    ``folder`` that of another.

    Pieces are known by a 64-bit hash of their characters. A table of one entry
    a slot answers for most pieces at once; others are merged, and take the slot.
    Everything known is forgotten when it passes ``most``.
    """

    def __init__(self, name: str = "byte_bpe_50k", folder: str | None = None, most: int = 500_000):
        if folder is None:
            import public_tokenizers

            folder = os.path.dirname(public_tokenizers.path(f"{name}.json"))
        import tiktoken

        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._core = tiktoken.Encoding(name, pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self._file, self._whole, self._most = f"{folder}/{name}.json", None, most
        self._forget()

    def _forget(self) -> None:
        self._known = 0
        self._key = np.zeros(_SLOTS, dtype=np.uint64)
        self._value = np.zeros(_SLOTS, dtype=np.int32)
        self._at = np.zeros(1024, dtype=np.int64)
        self._length = np.zeros(1024, dtype=np.int64)
        self._ids = np.zeros(4096, dtype=np.uint16)
        self._used = 0

    def _slow(self, text: str) -> np.ndarray:
        if self._whole is None:
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            self._whole = Tokenizer.from_file(self._file)
            self._whole.encode_special_tokens = True
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, dtype=np.uint16)

    def _learn(self, texts: list[str]) -> np.ndarray:
        """Merge pieces and return their numbers."""
        merge = self._core._core_bpe.encode_single_piece
        made = [merge(t.encode()) for t in texts]
        n, lengths = self._known, np.array([len(m) for m in made], dtype=np.int64)
        while n + len(made) > len(self._at):
            self._at, self._length = np.resize(self._at, 2 * len(self._at)), np.resize(self._length, 2 * len(self._length))
        more = int(lengths.sum())
        if self._used + more > len(self._ids):
            self._ids = np.resize(self._ids, 2 * (self._used + more))
        self._at[n : n + len(made)] = self._used + np.cumsum(lengths) - lengths
        self._length[n : n + len(made)] = lengths
        self._ids[self._used : self._used + more] = np.fromiter(chain.from_iterable(made), np.uint16, more)
        self._used += more
        self._known += len(made)
        return np.arange(n, n + len(made))

    def _numbers(self, h: np.ndarray, start: np.ndarray, end: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The number of each piece among the known ones."""
        slot = (h >> np.uint64(44)).astype(np.int64)
        out = self._value[slot].astype(np.int64)
        far = np.flatnonzero(self._key[slot] != h)
        if len(far):
            new, one, back = np.unique(h[far], return_index=True, return_inverse=True)
            at = far[one]
            whole = points.astype("<u4").tobytes().decode("utf-32-le")
            found = self._learn([whole[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())])
            out[far] = found[back]
            where = (new >> np.uint64(44)).astype(np.int64)
            self._key[where], self._value[where] = new, found
        return out

    def encode_chunk(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of consecutive UTF-8 texts."""
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        chars = offsets if len(points) == len(data) else np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
        if len(points) and points.max() >= _LIMIT:
            out = []
            for a, b, x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), chars[:-1].tolist(), chars[1:].tolist()):
                if x < y and points[x:y].max() >= _LIMIT:
                    out.append(self._slow(data[a:b].tobytes().decode()))
                else:
                    out += self.encode_chunk(data[a:b], np.array([0, b - a]))
            return out
        if not len(points):
            return [np.zeros(0, dtype=np.uint16)] * (len(offsets) - 1)
        if self._known > self._most:
            self._forget()
        texts = np.unique(chars[:-1][chars[:-1] < len(points)])
        start = pieces(points, texts)
        end = np.append(start[1:], len(points))
        power, inverse = powers(len(points) + 1)
        total = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(_POINTS[points] * power[: len(points)], out=total[1:])
        h = mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        number = self._numbers(h, start, end, points)
        length = self._length[number]
        upto = np.concatenate(([0], np.cumsum(length)))
        ids = self._ids[np.repeat(self._at[number] - upto[:-1], length) + np.arange(upto[-1])]
        cut = upto[np.searchsorted(start, chars)]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def encode(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        return self.encode_chunk(data, np.array([0, len(data)]))[0]

    def encode_column(self, column: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(first row, ids of each text) for runs of rows; null texts are empty."""
        for i, data, offsets in text_chunks(column, 1 << 18):
            yield i, self.encode_chunk(data, offsets)
        trim()


_MADE: dict[tuple, Bpe] = {}


def bpe(name: str = "byte_bpe_50k", folder: str | None = None) -> Bpe:
    """One per Python worker."""
    if (name, folder) not in _MADE:
        _MADE[name, folder] = Bpe(name, folder)
    return _MADE[name, folder]
