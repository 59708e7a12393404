import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm import cases
from worklog.llm import lexical_search as ls


def slow_terms(text):
    return re.findall(ls.TERM, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(data, queries, k):
    """data: (identifier, text); queries: (identifier, text)."""
    counts = [Counter(slow_terms(t)) for _, t in data]
    docs, total = sum(1 for c in counts if c), sum(c.total() for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in queries:
        scores = []
        for (i, _), c in zip(data, counts, strict=True):
            m = 100 - 50 + (50 * c.total() * docs) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(slow_terms(text)) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def frames(spark, data, queries):
    docs = spark.createDataFrame([(i, t, "x", "x", "x") for i, t in data], "doc_id long, text string, _id string, n string, terms string").repartition(3)
    return docs, spark.createDataFrame([(i, t, "x", "x") for i, t in queries], "item_id long, text string, query string, _terms string")


def corpus(rnd, n, words):
    topics = [[f"w{int(rnd.paretovariate(0.6)) % words}" for _ in range(60)] for _ in range(8)]
    return [(i, " ".join(rnd.choices(rnd.choice(topics), k=rnd.randrange(1, 60)) + [f"w{int(rnd.paretovariate(0.6)) % words}" for _ in range(rnd.randrange(20))])) for i in range(n)]


@pytest.mark.parametrize(("shard", "postings", "group", "k"), [(4096, 1 << 20, 1 << 18, 10), (100, 1 << 20, 200, 5), (300, 700, 1 << 18, 3)])
def test_matches_brute_force(spark, monkeypatch, shard, postings, group, k):
    for name, value in (("SHARD_DOCS", shard), ("SHARD_POSTINGS", postings)):
        monkeypatch.setattr(ls, name, value)
    rnd = random.Random(shard + k)
    data = corpus(rnd, 600, 3000)
    queries = [(i, t) for i, (_, t) in enumerate(corpus(rnd, 25, 3000))]
    docs, asked = frames(spark, data, queries)
    got = ls.search(docs, asked, k, group_terms=group).collect()
    assert sorted(map(tuple, got), key=str) == brute(data, queries, k)


@pytest.mark.parametrize(("block", "heavy"), [(2, 1024), (4, 15), (16, 1024)])
def test_blocks_are_skipped_and_nothing_is_lost(monkeypatch, block, heavy):
    monkeypatch.setattr(ls, "BLOCK_DOCS", block)
    monkeypatch.setattr(ls, "HEAVY", heavy)
    rnd = random.Random(block)
    data = corpus(rnd, 800, 2000)
    counts = [Counter(t for t in ls.terms_of(text)) for _, text in data]
    df = Counter(t for c in counts for t in c)
    order = sorted(df, key=lambda t: (df[t], t))
    rank = {t: i for i, t in enumerate(order)}
    weight = np.array([math.floor(1000 * math.log((2 * 800 + 2) / (2 * df[t] + 1))) for t in order], np.int64)
    total = sum(c.total() for c in counts)
    norms = np.array([50 + 50 * c.total() * 800 // total for c in counts])
    terms, held = (np.array([x for c in counts for x in own(c)]) for own in (lambda c: [rank[t] for t in c], lambda c: list(c.values())))
    project = np.random.default_rng(1).standard_normal((len(order), 8)).astype(np.float32)
    arrays = ls.make_shard(np.arange(800), norms, np.array([len(c) for c in counts]), terms, held, weight, project)
    shard = ls.Shard({c: a.astype(ls.types_of(len(order))[c]) for c, a in arrays.items()}, len(order))
    scored = []
    whole = shard.scores
    shard.scores = lambda docs, w: scored.append(len(docs)) or whole(docs, w)
    matching = 0
    for _, text in corpus(rnd, 20, 2000):
        query = np.sort(np.array(sorted({rank[t] for t in ls.terms_of(text) if t in rank})))
        own = np.zeros(len(order), np.int64)
        own[query] = weight[query]
        got = shard.search(query, weight[query], own, (np.empty(0, np.int64),) * 2, 5)
        all_scores = np.array([sum(int(own[rank[t]]) * (1_000_000_000 * n // (1000 * n + 20 * int(m))) for t, n in c.items()) for c, m in zip(counts, norms, strict=True)])
        want = sorted((-s, i) for i, s in enumerate(all_scores) if s > 0)[:5]
        assert [(-s, i) for s, i in zip(*(x.tolist() for x in got), strict=True)] == want
        matching += int((all_scores > 0).sum())
    assert sum(scored) < 0.8 * matching


def test_awkward_tables(spark):
    data = [(i, t) for i, t, _ in cases.rows()] + [(70, "É é über-Straße naïve"), (71, "x" * 5000), (72, "\x00a\x00b")]
    queries = [(1, "own 3 this LINE"), (2, None), (3, ""), (4, "x"), (4, "X x"), (None, "same text"), (5, "日本語 é über naïve b"), (6, "nothing-of-this_is_there zzz"), (7, " ".join(f"w{i}" for i in range(400)))]
    docs, asked = frames(spark, data, queries)
    assert sorted(map(tuple, ls.search(docs, asked, 7).collect()), key=str) == brute(data, queries, 7)
    for d, q in (([], queries), (data, []), ([(1, None)], queries)):
        assert ls.search(*frames(spark, d, q), 7).collect() == []


def test_whole_table_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    data, queries = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = ls.op13_lexical_search(spark, sf)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == brute(data, queries, 50)
