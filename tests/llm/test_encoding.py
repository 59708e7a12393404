import random
import zlib
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm import cases
from worklog.llm import common, sentencepiece_codec, token_store
from worklog.llm.sentencepiece_codec import codec, encode_and_decode

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    alphabet = "aabbeehtn  \n.,-1230é日▁xX"
    out = [t or "" for _, t, _ in cases.rows()] + ["  a  b ", "\t", "x" * 300, "aa" * 100 + " " + "ab" * 99, "日本語🙂" * 20, "   ", "▁"]
    out += ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(800)]
    out += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x80, 0x3000), rnd.randrange(0x1F300, 0x1F600)])) for _ in range(30)) for _ in range(300)]
    return out


def test_codec_is_the_librarys(texts):
    own, library = codec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in texts:
        ids = library.encode(text)
        assert own.encode(text).tolist() == ids
        assert own.decode(ids) == library.decode(ids)
    rnd = random.Random(2)
    for ids in [[rnd.randrange(32_000) for _ in range(6)] for _ in range(300)] + [[rnd.randrange(3, 259) for _ in range(5)] for _ in range(300)] + [[0, 5], [1, 264, 2]]:
        assert own.decode(ids) == library.decode(ids)


def test_sentencepiece_of_awkward_tables(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sorted(((r.doc_id, list(r.ids), r.decoded) for r in encode_and_decode(cases.frame(spark)).collect()), key=str)
    want = sorted(((i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, _ in cases.rows()), key=str)
    assert got == want
    assert encode_and_decode(cases.frame(spark, [])).collect() == []


def test_words_are_encoded_as_in_whole_texts(texts):
    own, library = token_store.WordEncoder(BYTES, 2), Tokenizer.from_file(BYTES)
    more = [t.replace("▁", " ") + x for t in texts[:300] for x in ("", "   y", "\n z ", " 's 'll")]
    found = [own.encode_batch(pa.array(part)).to_pylist() for part in (texts + more, more, [])]  # the second time they are remembered
    assert found[1] == found[0][len(texts) :] and found[2] == []
    for text, raw in zip(texts + more, found[0], strict=True):
        assert np.frombuffer(raw, "<u2").tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("limit", [0, 5, 10**6])
def test_remembered_words_keep_their_ids(monkeypatch, texts, limit):
    monkeypatch.setattr(token_store, "CACHE", limit)
    monkeypatch.setattr(sentencepiece_codec, "CACHE", limit)
    own, pieces = token_store.WordEncoder(BYTES, 2), sentencepiece_codec.PrefixTableCodec(PIECES)
    library, other = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for part in (texts[:200], texts[100:300], texts[:200]):
        assert [np.frombuffer(x, "<u2").tolist() for x in own.encode_batch(pa.array(part)).to_pylist()] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in part]
        found = pieces.encode_batch(pa.array(part))
        assert [found.flat[a:b].tolist() for a, b in pairwise(found.ends)] == [other.encode(t) for t in part]


def test_slices_hold_so_many_bytes():
    batch = pa.record_batch([pa.array(["a" * 5, None, "b" * 40, "", "c" * 6, "d" * 4])], ["t"])
    assert [s.column(0).to_pylist() for s in common.slices(iter([batch, batch.slice(0, 0)]), 0, 10)] == [["aaaaa", None], ["b" * 40], ["", "cccccc", "dddd"]]


def test_token_store_round_trip(spark):
    library = Tokenizer.from_file(BYTES)
    data = [r for r in cases.rows() if r[0] is not None]
    folder = common.shared_folder(spark, "tables")
    shards = token_store.write_tables(cases.frame(spark, data), folder)
    got = token_store.read_tables(shards).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(i for i, *_ in data)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t, _ in data}
    start = 0
    for r in got:
        assert (r.start, r.n_tokens) == (start, len(ids[r.doc_id]))
        assert zlib.crc32(bytes(r.ids)) == zlib.crc32(np.array(ids[r.doc_id], "<u4").tobytes())
        start += r.n_tokens
    readers = [token_store.TableReader(r.path) for r in shards.collect()]
    for i in ids:
        assert [x.tolist() for t in readers if (x := t.get(i)) is not None] == [ids[i]]
    assert all(t.get(i) is None for t in readers for i in (-5, 7, 10**12))
    files = shards.orderBy("shard").collect()
    assert all(a.last_id <= b.first_id for a, b in pairwise(files))
    assert all(token_store.look_up(shards, i).tolist() == ids[i] for i in list(ids)[:5]) and token_store.look_up(shards, 10**12) is None


def test_token_store_of_awkward_tables(spark):
    shards = token_store.write_tables(cases.frame(spark), common.shared_folder(spark, "tables"))
    got = token_store.read_tables(shards).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, *_ in cases.rows())
    assert token_store.read_tables(token_store.write_tables(cases.frame(spark, []), common.shared_folder(spark, "tables"))).collect() == []


def test_large_values_and_many_keys_keep_the_format(tmp_path):
    import pyarrow.fs

    rnd = random.Random(4)
    entries = sorted((rnd.randrange(-(2**63), 2**63), rnd.randbytes(2 * rnd.choice([1, 50, 40_000]))) for _ in range(300))
    writer = token_store.TableWriter(pyarrow.fs.LocalFileSystem(), str(tmp_path / "t.sst"), 2)
    for i, raw in entries:
        writer.add(i, raw)
    writer.close()
    table = token_store.TableReader(f"file://{tmp_path}/t.sst")
    assert list(table) == entries and table.docs == 300 and len(table.index) > 5
    for i, raw in entries:
        assert table.get(i).tobytes() == raw
