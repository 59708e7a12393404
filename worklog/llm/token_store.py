"""Token ids in sorted-string-table files.

The documents are keyed by identifier. A file holds blocks of entries in key order, each key stored as the length that it
shares with the key before it and the rest; then a sparse index with each block's first key, a Bloom filter of the keys
and a footer. Keys are eight bytes big-endian with the sign turned, so their order as bytes is that of the identifiers.

    entry   varint shared, varint rest, varint size, rest of the key, token ids (16 or 32 bits, little-endian)
    index   for each block: 9 bytes first key (padded), u64 offset, u32 length, u32 entries
    footer  u64 index offset, u32 blocks, u64 Bloom offset, u32 Bloom bytes, u64 documents, u64 tokens, u8 id bytes, magic
"""

from __future__ import annotations

import struct
import uuid
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common
from .ragged import Ragged, Remembered, parted

MAGIC, BLOCK_BYTES, BLOOM_BITS, BLOOM_HASHES = b"WLSST1\n\0", 1 << 16, 10, 7
INDEX, FOOTER = struct.Struct(">9sQII"), struct.Struct(">QIQIQQB8s")
#: Stems that a worker remembers, words in a line for the library, and bytes of text in one go.
CACHE, LINE, ENCODE_BYTES = 400_000, 500, 8 << 20
#: Latin letters, then punctuation without the apostrophe, which begins tokens of its own kind.
STEM_AND_TAIL = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ɏ]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"
#: Empty, or white space (Unicode's, and the four separators of ASCII) at an end.
EDGE_SPACE = r"^$|^[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]|[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]$"


def key_of(doc_id: int | None) -> bytes:
    """Null is the empty key, which is before all others."""
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bits(h: int, size: int) -> list[int]:
    """The Bloom filter's bits of a key with this hash."""
    return [(h + i * (h >> 32 | 1)) % size for i in range(BLOOM_HASHES)]


class TableWriter:
    """Writes one file; it gets its name only when it is whole, so a task that is run again does no harm."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str, width: int):
        self.fs, self.path, self.width, self.temporary = fs, path, width, f"{path}.{uuid.uuid4().hex}"
        self.out = fs.open_output_stream(self.temporary)
        self.offset = self.docs = self.tokens = 0
        self.index: list[bytes] = []
        self.hashes = array("Q")
        self.first_id: int | None = None
        self.last_id: int | None = None
        self._fresh()

    def _fresh(self) -> None:
        self.block, self.first, self.last, self.entries, self.bytes = [], None, b"", 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        key = key_of(doc_id)
        if self.bytes and self.bytes + len(ids) > BLOCK_BYTES:
            self._end_block()
        shared = next((i for i, (a, b) in enumerate(zip(key, self.last)) if a != b), min(len(key), len(self.last)))  # noqa: B905
        head = _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:]
        self.block += [head, ids]
        self.first, self.last = (key if self.first is None else self.first), key
        self.entries, self.bytes = self.entries + 1, self.bytes + len(head) + len(ids)
        self.hashes.append(xxhash.xxh3_64_intdigest(key))
        self.first_id, self.last_id = (self.first_id if self.docs else doc_id), doc_id
        self.docs, self.tokens = self.docs + 1, self.tokens + len(ids) // self.width

    def _end_block(self) -> None:
        raw = b"".join(self.block)
        self.out.write(raw)
        self.index.append(INDEX.pack(self.first, self.offset, len(raw), self.entries))
        self.offset += len(raw)
        self._fresh()

    def close(self) -> None:
        if self.bytes:
            self._end_block()
        size = max(64, -(-len(self.hashes) * BLOOM_BITS // 8) * 8)
        bloom = bytearray(size // 8)
        for h in self.hashes:
            for bit in _bits(h, size):
                bloom[bit >> 3] |= 1 << (bit & 7)
        self.out.write(b"".join(self.index) + bloom)
        at = self.offset + INDEX.size * len(self.index)
        self.out.write(FOOTER.pack(self.offset, len(self.index), at, len(bloom), self.docs, self.tokens, self.width, MAGIC))
        self.out.close()
        self.fs.move(self.temporary, self.path)


class TableReader:
    def __init__(self, uri: str):
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        self.file.seek(self.file.size() - FOOTER.size)
        at, blocks, bloom_at, bloom_bytes, self.docs, self.tokens, self.width, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token table")
        self.file.seek(at)
        raw = self.file.read(blocks * INDEX.size)
        self.index = list(INDEX.iter_unpack(raw))
        self.file.seek(bloom_at)
        self.bloom = self.file.read(bloom_bytes)

    def _block(self, k: int) -> Iterator[tuple[int | None, bytes]]:
        _, offset, length, entries = self.index[k]
        self.file.seek(offset)
        raw, at, key = self.file.read(length), 0, b""
        for _ in range(entries):
            sizes = []
            for _ in range(3):
                n = shift = 0
                while True:
                    byte, at = raw[at], at + 1
                    n |= (byte & 127) << shift
                    shift += 7
                    if byte < 128:
                        break
                sizes.append(n)
            shared, rest, size = sizes
            key = key[:shared] + raw[at : at + rest]
            yield id_of(key), raw[at + rest : at + rest + size]
            at += rest + size

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for k in range(len(self.index)):
            yield from self._block(k)

    def ids(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, f"<u{self.width}")

    def get(self, doc_id: int) -> np.ndarray | None:
        """The ids of the first document with this identifier: Bloom filter, binary search of the index, one or two blocks."""
        key, size = key_of(doc_id), len(self.bloom) * 8
        if not all(self.bloom[bit >> 3] >> (bit & 7) & 1 for bit in _bits(xxhash.xxh3_64_intdigest(key), size)):
            return None
        firsts = [first[:8] for first, *_ in self.index]
        place = bisect_right(firsts, key) - 1
        while place > 0 and firsts[place] == key:
            place -= 1
        for k in range(max(place, 0), min(max(place, 0) + 2, len(self.index))):
            for found, raw in self._block(k):
                if found == doc_id:
                    return self.ids(raw)
        return None


class WordEncoder:
    """Byte-level BPE through the tokenizers library, which sees each stem once as long as it is remembered.

    A space that something other than white space follows always begins a token, so a text parts there; texts with other
    runs of white space, or with special tokens, go to the library whole. Letters and the punctuation behind them never
    share a token either, so a word's ids are its stem's and its tail's. Arrow's dictionary encoding tells the words of a
    batch apart, and numpy gathers the ids of the whole batch. The library gets new stems in lines of many, and their ids
    part where the tokens' bytes add up to the stems'.
    """

    def __init__(self, file: str, end_id: int):
        self.library = Tokenizer.from_file(file)
        self.width = 2 if max(self.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.type = f"<u{self.width}"
        self.end = np.array([end_id], self.type)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        names = {i: n for n, i in self.library.get_vocab().items()}
        self.token_bytes = np.array([len(names.get(i, "")) for i in range(max(names) + 1)])  # a character of a name is a byte
        self.stems = Remembered(self._after_space, self.type, CACHE)

    def _ask(self, texts: list[str]) -> Ragged:
        return Ragged.of([np.array(e.ids, self.type) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)], self.type)

    def _after_space(self, words: pa.Array) -> Ragged:
        """The ids of each word as behind a space; words have no white space at their ends."""
        if not len(words):
            return self._ask([])
        lines = self._ask([" " + " ".join(words.slice(k, LINE).to_pylist()) for k in range(0, len(words), LINE)])
        reached, wanted = np.cumsum(self.token_bytes[lines.flat]), np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)
        ends = np.searchsorted(reached, wanted) + 1
        if ends[-1] != len(reached) or not np.array_equal(reached[ends - 1], wanted):
            return self._ask([f" {w}" for w in words.to_pylist()])
        return Ragged(lines.flat, np.concatenate([[0], ends]))

    def encode_batch(self, texts: pa.Array) -> pa.Array:
        """The ids of each text with the end id, as binary."""
        if not len(texts):
            return pa.array([], pa.binary())
        parts = pc.split_pattern(texts, " ")
        begin, coded = parts.offsets.to_numpy().astype(np.int64), parts.flatten().dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy()
        odd = np.logical_or.reduceat(pc.match_substring_regex(words, EDGE_SPACE).to_numpy(zero_copy_only=False)[at], begin[:-1])
        for token in self.special:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if odd.any():
            whole = self._ask(texts.filter(pa.array(odd)).to_pylist())
            ends = np.flatnonzero(odd)
            singly = [(whole.flat[a:b].tobytes() + self.end.tobytes()) for a, b in zip(whole.ends[:-1], whole.ends[1:], strict=True)]
            rest = self.encode_batch(texts.filter(pa.array(~odd))).to_pylist()
            out: list[bytes] = [b""] * len(texts)
            for k, raw in [*zip(ends, singly, strict=True), *zip(np.flatnonzero(~odd), rest, strict=True)]:
                out[k] = raw
            return pa.array(out, pa.binary())
        heads, head = np.unique(at[begin[:-1]], return_inverse=True)
        known = parted(words, STEM_AND_TAIL, self.stems, lambda tails: self._ask(tails.to_pylist()))
        ids = Ragged.joined([known, self._ask(words.take(pa.array(heads)).to_pylist()), Ragged.of([self.end], self.type)])
        rows = at.astype(np.int64)
        rows[begin[:-1]] = len(words) + head
        found = ids.take(np.insert(rows, begin[1:], len(words) + len(heads)))
        ends = found.ends[begin + np.arange(len(begin))] * self.width
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(found.flat)])


@lru_cache(2)
def encoder(file: str, end_id: int) -> WordEncoder:
    return WordEncoder(file, end_id)


def encode(docs: DataFrame, file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id and _ids (binary, little-endian) of each row of docs.

    Null counts as empty and has the end id alone; whole texts are encoded; repeated rows and identifiers give as many
    rows; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(file, end_id)
        for batch in common.slices(batches, 1, ENCODE_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), own.encode_batch(pc.fill_null(batch.column(1), ""))], ["_id", "_ids"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string")).mapInArrow(run, "_id long, _ids binary")


def write_tables(docs: DataFrame, folder: str, file: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode docs and write one file for each block of identifiers; returns shard, path, first_id, last_id, n_docs, n_tokens, start.

    Files follow each other in ascending order of identifier, rows without one first; start is the number of ids in all
    files before. Null and empty texts have the end id alone. Rows with one identifier are entries of their own. An
    empty table gives no file. The folder is a URI that driver and executors share. The result is the list of the files
    with the identifiers that each begins and ends with, so a lookup opens only the file that may hold its key.
    """
    spark = docs.sparkSession
    file = file or public_tokenizers.path("byte_bpe_50k.json")
    n = common.shuffle_partitions(spark)
    cuts = common.splitters(docs.select(F.col(id_col).cast("long").alias("_id")), "_id", n)
    sorted_ids = common.with_block(encode(docs, file, end_id, id_col, text_col), "_id", cuts, "_block").repartitionById(n, "_block").sortWithinPartitions("_block", "_id", "_ids")
    width = WordEncoder(file, end_id).width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base)
        done, writer, now = [], None, None

        def close() -> None:
            writer.close()
            done.append((now, f"{folder}/{now:06d}.sst", writer.first_id, writer.last_id, writer.docs, writer.tokens))

        for batch in common.slices(batches, 1):
            for i, ids, block in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                if block != now:
                    if writer:
                        close()
                    writer, now = TableWriter(fs, f"{base}/{block:06d}.sst", width), block
                writer.add(i, ids)
        if writer:
            close()
        columns = list(zip(*done, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), *[pa.int64()] * 4), strict=True)], ["shard", "path", "first_id", "last_id", "n_docs", "n_tokens"])

    shards = common.stored(sorted_ids.select("_id", "_ids", "_block").mapInArrow(run, "shard int, path string, first_id long, last_id long, n_docs long, n_tokens long"), "token-shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tables(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, unsigned 32-bit little-endian) of each document in the files."""
    n = common.shuffle_partitions(shards.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "n_tokens", "ids"])

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                table, rows = TableReader(path), []
                for doc_id, raw in table:
                    ids = table.ids(raw)
                    rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes()))
                    start += len(ids)
                    if len(rows) >= 200:
                        yield packed(rows)
                        rows = []
                yield packed(rows)

    dealt = shards.select("path", "start", "shard").repartitionById(n, F.pmod("shard", F.lit(n))).drop("shard")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def look_up(shards: DataFrame, doc_id: int) -> np.ndarray | None:
    """The ids of the first document with this identifier; at most the files whose range holds it are opened."""
    for row in shards.filter((F.col("first_id").isNull() | (F.col("first_id") <= doc_id)) & (F.col("last_id") >= doc_id)).orderBy("shard").select("path").collect():
        if (found := TableReader(row.path).get(doc_id)) is not None:
            return found
    return None


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_tables(common.documents(spark, sf_dir), common.shared_folder(spark, "token-tables"))
    return read_tables(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
