"""Encoding and decoding with a SentencePiece BPE model by a merge-type prefix table.

The encoding of every prefix of a text ends in one particular token. An automaton lists the pieces that end at each
position; of these, exactly one fits the last token of the prefix before it, which a pair test tells by undoing merges
on both sides of the border, latest first. With the table of last tokens full, the ids are read from the end backwards.
The work is linear in the length of the text.

No piece goes across words, so the table is filled for each different word of a batch once, and the ids of the texts are
gathered in numpy.
"""

from __future__ import annotations

import string
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .ragged import Ragged, Remembered, parted

SPACE = "▁"
#: Words and pairs of tokens that a worker remembers.
CACHE, PAIRS = 250_000, 400_000
LETTERS = string.ascii_letters


class PrefixTableCodec:
    """encode() and decode() as the library does them without begin and end ids."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = range(model.vocab_size())
        names = [model.id_to_piece(i) for i in size]
        special = {i for i in size if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.ids = {names[i]: i for i in size if i not in special}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        probe = f"  AＡ  {SPACE} é "
        if any(SPACE in n.lstrip(SPACE) for n in self.ids) or not all(c in self.ids for n in self.ids for c in n) or model.is_unknown(self.byte_ids[0]) or model.decode(model.encode(probe)) != probe.replace(SPACE, " "):
            raise ValueError("the model needs byte fallback, identity normalisation, single pieces for all characters and no piece across words")
        by_score = sorted((n for n in self.ids if len(n) > 1), key=lambda n: -model.get_score(self.ids[n]))
        #: When a piece is merged: single characters are there from the start.
        self.time = {n: 0 for n in self.ids if len(n) == 1} | {n: t for t, n in enumerate(by_score, 1)}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.names, self.lengths = names, [len(n) for n in names]
        self.fits: list[dict[int, bool]] = [{} for _ in names]
        self.n_fits, self.longest = 0, max(map(len, self.ids))
        joined = {b for n in self.ids for a, b in zip(n, n[1:]) if a in LETTERS}  # noqa: B905
        #: No piece has a letter and such a mark behind it, so no merge does either.
        self.stem_and_tail = f"^(?P<stem>[{LETTERS}]+)(?P<tail>[{''.join(f'\\x{ord(c):02X}' for c in string.punctuation if c not in joined)}]*)$"
        self.stems = Remembered(lambda words: self._all(words, SPACE), "<i4", CACHE)
        self.matches = ahocorasick.Automaton()
        for n, i in self.ids.items():
            self.matches.add_word(n, (i, len(n)))
        self.matches.make_automaton()
        self.surface = [n.replace(SPACE, " ").encode() for n in names]
        for i in special:
            self.surface[i] = b""
        for b, i in enumerate(self.byte_ids):
            self.surface[i] = bytes([b])
        self.surface[model.unk_id()] = " ⁇ ".encode()
        self.spaced = {i for n, i in self.ids.items() if n[0] == SPACE}
        self.silent = {i for i in special if not self.surface[i]}

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes this one; None if its characters never end up as this piece."""
        if piece not in self.halves:
            cuts = ((piece[:k], piece[k:]) for k in range(1, len(piece)))
            good = (c for c in cuts if c[0] in self.time and c[1] in self.time and self._reachable(c[0]) and self._reachable(c[1]) and self._fit(*c, self.time[piece]))
            self.halves[piece] = next(good, None)
        return self.halves[piece]

    def _reachable(self, piece: str) -> bool:
        return len(piece) == 1 or self._halves(piece) is not None

    def _fit(self, left: str, right: str, limit: float) -> bool:
        """Whether no merge across the border comes before the limit while both sides are undone, latest merge first."""
        time = self.time
        while True:
            if (across := time.get(left + right)) is not None and across < limit:
                return False
            a, b = time[left], time[right]
            if not a and not b:
                return True
            if a > b:
                limit, left = a, self._halves(left)[1]
            else:  # of two equal merges the left one is first, so one across the border comes before the right side's
                limit, right = b + 1, self._halves(right)[0]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether a text can end in these two tokens; left is -1 where right comes first."""
        if self.n_fits > PAIRS:
            self.fits, self.n_fits = [{} for _ in self.names], 0
        good = self._reachable(self.names[right]) and (left < 0 or self._fit(self.names[left], self.names[right], float("inf")))
        self.fits[right][left], self.n_fits = good, self.n_fits + 1
        return good

    def _all(self, words: pa.Array, before: str = "") -> Ragged:
        """The ids of words with so much before each; no merge crosses the border of a word.

        The words are taken in order, so that each goes on with the table of the beginning that it shares with the last.
        """
        flat, ends, order = array("i"), [0], pc.sort_indices(words)
        last: list[int] = []
        done = ""
        for word in words.take(order).to_pylist():
            word = before + word
            k, n = 0, min(len(word), len(done))
            while k < n and word[k] == done[k]:
                k += 1
            last[k:] = [-1] * (len(word) - k)
            self._fill(word, last, k)
            ids, end, done = [], len(word) - 1, word
            while end >= 0:
                if (piece := last[end]) < 0:  # a character without a piece: its bytes, and a border for merges
                    ids += [self.byte_ids[b] for b in reversed(word[end].encode())]
                    end -= 1
                else:
                    ids.append(piece)
                    end -= self.lengths[piece]
            ids.reverse()
            flat.extend(ids)
            ends.append(len(flat))
        place = np.empty(len(words), np.int64)
        place[order.to_numpy()] = np.arange(len(words))
        return Ragged(np.frombuffer(flat, "<i4") if flat else np.empty(0, "<i4"), np.array(ends)).take(place)

    def _fill(self, word: str, last: list[int], start: int) -> None:
        """The last token of each prefix that ends at start or behind."""
        fits, compatible = self.fits, self._compatible
        for end, (piece, length) in self.matches.iter(word, max(0, start - self.longest + 1)):
            if end >= start and last[end] < 0:
                before = last[end - length] if end >= length else -1
                good = fits[piece].get(before)
                if compatible(before, piece) if good is None else good:
                    last[end] = piece

    def encode_batch(self, texts: pa.Array) -> Ragged:
        """The ids of each text. Words part at spaces; each has the spaces before it, and the last of a text those behind."""
        parts = pc.split_pattern(pc.replace_substring(texts, SPACE, " "), " ")
        begin, coded = parts.offsets.to_numpy().astype(np.int64), parts.flatten().dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        place = np.flatnonzero(pc.binary_length(words).to_numpy()[at] > 0)
        of = np.searchsorted(begin[1:], place, side="right")
        spaces = place - np.maximum(np.concatenate([[-1], place[:-1]])[: len(place)] + 1, begin[of])
        rows, wide = at[place], np.flatnonzero(spaces)
        last = begin[:-1].copy()
        np.maximum.at(last, of, place + 1)
        behind = np.where(pc.binary_length(texts).to_numpy() > 0, begin[1:] - last, 0)
        more = pa.array([SPACE * int(n) + w for n, w in zip(spaces[wide], words.take(pa.array(at[place[wide]])).to_pylist(), strict=True)] + [SPACE * int(n - 1) for n in behind[behind > 0]], pa.string()).dictionary_encode()
        extra = more.indices.to_numpy() + np.int64(len(words))
        rows[wide] = extra[: len(wide)]
        counts = np.bincount(of, minlength=len(texts))
        ending = np.flatnonzero(behind > 0)
        rows = np.insert(rows, np.cumsum(counts)[ending], extra[len(wide) :])
        counts[ending] += 1
        known = parted(words, self.stem_and_tail, self.stems, self._all)
        found = Ragged.joined([known, self._all(more.dictionary, SPACE)]).take(rows)
        return Ragged(found.flat, found.ends[np.concatenate([[0], np.cumsum(counts)])])

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch(pa.array([text])).flat

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if i not in self.silent), None)
        if first in self.spaced:  # the space put before the text
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:  # each byte that belongs to no character becomes a replacement character
            out, k = [], 0
            while k < len(raw):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(raw[k : k + n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    n = 1
                k += n
            return "".join(out)


@lru_cache(2)
def codec(model_file: str) -> PrefixTableCodec:
    return PrefixTableCodec(model_file)


def encode_and_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None) -> DataFrame:
    """One row for each row of docs: id_col, ids array<int>, decoded string.

    Null counts as empty and has no ids; whole texts are encoded. Repeated rows and identifiers give as many rows; an
    empty table gives an empty result; other columns are not read.
    """
    model_file = model_file or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in common.slices(batches, 1):
            found = own.encode_batch(pc.fill_null(batch.column(1), ""))
            ids = pa.ListArray.from_arrays(pa.array(found.ends, pa.int32()), pa.array(found.flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([own.decode(found.flat[a:b].tolist()) for a, b in pairwise(found.ends)], pa.string())], [id_col, "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` long, ids array<int>, decoded string")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_and_decode(common.documents(spark, sf_dir))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256")
    )
