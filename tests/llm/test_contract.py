"""The registered queries over the smallest tables: columns, types, whole results, and the libraries' own output."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm import test_near
from worklog.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op2_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op3_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op4_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op5_sentencepiece": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op6_source_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op7_winnowing": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op8_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op9_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_token_store": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
}


PARTS = {
    "op11_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op12_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op13_lexical_search": "item_id bigint, rank int, doc_id bigint, score bigint",
}


@pytest.mark.parametrize("name", PARTS)
def test_columns_of_searches(spark, name):
    assert ", ".join(f"{c} {t}" for c, t in queries.queries()[name](spark, SF).dtypes) == PARTS[name]


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def results(spark):
    return {name: queries.queries()[name](spark, SF) for name in COLUMNS}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, results, name):
    df = results[name]
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    table, key = ("pages", "page_id") if name == "op3_url_filter" else ("documents", "doc_id")
    ids = [r[0] for r in df.select(key).collect()]
    assert sorted(ids) == sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())


def test_encodings_are_the_libraries(results, texts):
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in results["op5_sentencepiece"].collect():
        ids = pieces.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(pieces.decode(ids).encode()).hexdigest())
    library, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for r in sorted(results["op10_token_store"].collect()):
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_near_groups_of_whole_table(results, texts):
    want = test_near.brute_groups([(i, t, "") for i, t in texts.items()], 3, 85)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in results["op8_near_dedup"].collect()), key=str) == want


def test_quality_on_held_out_labels(spark):
    got = queries.queries()["op9_quality"](spark, "/root/testdata/sf0.01").filter("held_out")
    rows = got.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    good = [r.predicted for r in rows if r.quality == 1]
    bad = [r.predicted for r in rows if r.quality == 0]
    assert len(bad) > 3 and np.mean(good) >= 0.95 and np.mean(bad) <= 0.1
