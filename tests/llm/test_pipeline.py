"""Each stage of the pipeline against a brute-force version, on its own input."""

import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from tests.llm import cases, test_filters, test_near
from worklog.llm import quality


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs, labels = test_filters.labelled(4, 300)
    rnd, base = random.Random(8), test_filters.prose(random.Random(9), 120).split()
    for i in range(30):  # near copies of one good text
        place = rnd.randrange(110)
        docs.append((1000 + i, " ".join([*base[:place], *rnd.sample(base, i % 12), *base[place:]]), "a"))
    docs += [(2000 + i, t, "b") for i, t, _ in docs[:40]]
    docs += [(None if i is None else i + 5000, t, s) for i, t, s in cases.rows()]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    frames = [spark.read.parquet(f"{folder}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], folder).write.parquet(f"{folder}/stage{k}")
        frames.append(spark.read.parquet(f"{folder}/stage{k}"))
    return folder, frames


def triples(frame):
    return [(r.doc_id, r.text, r.source) for r in frame.collect()]


def test_columns_stay(stages):
    _, frames = stages
    assert all(f.columns == frames[0].columns for f in frames[:-1])
    assert frames[-1].columns == ["doc_id", "ids", "decoded"]


def test_quality_stage(spark, stages):
    folder, frames = stages
    scores = quality.quality_scores(frames[0], spark.read.parquet(f"{folder}/labels.parquet")).filter("predicted = 1")
    assert Counter(r.doc_id for r in scores.collect()) == Counter(i for i, *_ in triples(frames[1]))
    assert 0 < frames[1].count() < frames[0].count()


def test_exact_stage(stages):
    _, frames = stages
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    before, after = triples(frames[1]), triples(frames[2])
    groups = {}
    for i, text, _ in before:
        groups.setdefault(normal(text), []).append(i)
    assert Counter((normal(t), i) for i, t, _ in after) == Counter((t, min((i for i in ids if i is not None), default=None)) for t, ids in groups.items())


def test_near_stage(stages):
    _, frames = stages
    groups = test_near.brute_groups(triples(frames[2]), 5, 80)
    assert Counter(i for i, *_ in triples(frames[3])) == Counter(i for i, _, c in groups if i == c or i is None)
    assert frames[3].count() < frames[2].count()


def test_mixing_stage(stages):
    _, frames = stages
    before, after = triples(frames[3]), Counter(triples(frames[4]))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert set(after) <= set(before) and max(after.values()) <= 2
    total = sum(size(t) for _, t, _ in before) * 1.5
    assert total - max(size(t) for _, t, _ in before) <= sum(size(t) * n for (_, t, _), n in after.items()) <= total


def test_encoding_stage_and_run(spark, stages):
    folder, frames = stages
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((i, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for i, t, _ in triples(frames[4]))
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in frames[5].collect()) == want
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in corpus_pipeline.run(spark, folder).collect()) == want
