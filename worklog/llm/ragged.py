"""Rows of numbers of different lengths in numpy, and a table of such rows that remembers what it was asked for."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Ragged:
    """Rows one after the other, and where each begins."""

    def __init__(self, flat: np.ndarray, ends: np.ndarray):
        self.flat, self.ends = flat, ends

    def __len__(self) -> int:
        return len(self.ends) - 1

    @staticmethod
    def of(rows: list[np.ndarray], dtype: str) -> Ragged:
        return Ragged(np.concatenate([np.empty(0, dtype), *rows]), np.cumsum([0, *map(len, rows)]))

    @staticmethod
    def joined(parts: list[Ragged]) -> Ragged:
        before = np.cumsum([0, *[len(p.flat) for p in parts]])
        return Ragged(np.concatenate([p.flat for p in parts]), np.concatenate([[0], *[p.ends[1:] + n for p, n in zip(parts, before, strict=False)]]))

    def take(self, rows: np.ndarray) -> Ragged:
        sizes = (self.ends[1:] - self.ends[:-1])[rows]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return Ragged(self.flat[np.arange(ends[-1]) + np.repeat(self.ends[rows] - ends[:-1], sizes)], ends)


class Remembered:
    """The rows of different words; ask gives those of new words, and up to about so many words are remembered."""

    def __init__(self, ask: Callable[[pa.Array], Ragged], dtype: str, limit: int):
        self.ask, self.limit = ask, limit
        self.words, self.rows = pa.array([], pa.string()), Ragged.of([], dtype)

    def __call__(self, words: pa.Array) -> Ragged:
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(at))
        place = at.fill_null(-1).to_numpy().astype(np.int64)
        place[place < 0] = len(self.words) + np.arange(len(new))
        both = Ragged.joined([self.rows, self.ask(new)])
        found = both.take(place)
        if len(both) <= self.limit:
            self.words, self.rows = pa.concat_arrays([self.words, new]), both
        else:  # only the words of this batch go on
            self.words, self.rows = words, found
        return found


def parted(words: pa.Array, pattern: str, stems: Callable[[pa.Array], Ragged], tails: Callable[[pa.Array], Ragged]) -> Ragged:
    """The rows of words as those of their stems and tails, each asked for once; a word that does not match is all stem."""
    found = pc.extract_regex(words, pattern)
    stem = pc.coalesce(pc.struct_field(found, "stem"), words).dictionary_encode()
    tail = pc.fill_null(pc.struct_field(found, "tail"), "").dictionary_encode()
    rows = Ragged.joined([stems(stem.dictionary), tails(tail.dictionary)])
    places = np.stack([stem.indices.to_numpy().astype(np.int64), tail.indices.to_numpy() + np.int64(len(stem.dictionary))], 1)
    both = rows.take(places.ravel())
    return Ragged(both.flat, both.ends[::2])
