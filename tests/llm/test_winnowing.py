import hashlib
import random

import pytest

from tests.llm import cases
from worklog.llm import winnowing


def slow_choice(own, text):
    """Each window's least hash, the rightmost of equal ones."""
    hashes = own.hashes(text).tolist()
    w = min(own.w, len(hashes))
    places = sorted({max(range(i, i + w), key=lambda p: (-hashes[p], p)) for i in range(len(hashes) - w + 1)} if hashes else [])
    return [hashes[p] for p in places], places


@pytest.mark.parametrize(("k", "w"), [(1, 1), (3, 5), (12, 69)])
def test_choice_matches_windows(k, w):
    own, rnd = winnowing.Winnower(k, w), random.Random(k)
    for _ in range(60):
        text = "".join(rnd.choice("ab cé日") for _ in range(rnd.randrange(250)))
        hashes, places = own.choose(text)
        assert (hashes.tolist(), places.tolist()) == slow_choice(own, text)
        assert own.hashes(text).tolist() == [own.hashes(text[i : i + k]).tolist()[0] for i in range(max(1, len(text) - k + 1)) if text]


def test_long_shared_runs_are_found():
    own, rnd = winnowing.Winnower(6, 10), random.Random(9)
    for _ in range(100):
        noise = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(80)))
        shared = "".join(rnd.choice("abcdefgh") for _ in range(15))
        a, b = (own.choose(noise() + shared + noise())[0].tolist() for _ in range(2))
        assert set(a) & set(b)


def want(data):
    own = winnowing.Winnower(winnowing.K, winnowing.W)
    order = sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    out = []
    for n, (i, text, _) in enumerate(order):
        text, following = text or "", order[(n + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        chosen = [own.choose(t) for t in (text, edited, following)]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), winnowing.as_text(chosen[0]), winnowing.as_text(chosen[1]), winnowing.likeness(chosen[0][0], chosen[1][0]), winnowing.likeness(chosen[0][0], chosen[2][0])))
    return out


@pytest.mark.parametrize("data", [cases.rows(), cases.unique(), [(5, "alone", "a")], [(None, "a b c", "a")], []])
def test_edits_match_brute_force(spark, data):
    got = [(r.doc_id, r.n_chars, hashlib.sha256(r.edited_text.encode()).hexdigest(), *r[3:]) for r in winnowing.edited_likeness(cases.frame(spark, data)).collect()]
    assert sorted(got, key=str) == sorted(want(data), key=str)


def test_fingerprints_of_awkward_tables(spark):
    got = winnowing.fingerprints(cases.frame(spark)).collect()
    own = winnowing.Winnower()
    assert sorted(map(str, got)) == sorted(str(type(got[0])(doc_id=i, n_chars=len(t or ""), fingerprint=winnowing.as_text(own.choose(t or "")))) for i, t, _ in cases.rows()) or {
        (r.doc_id, r.n_chars, r.fingerprint) for r in got
    } == {(i, len(t or ""), winnowing.as_text(own.choose(t or ""))) for i, t, _ in cases.rows()}


def test_the_query_finds_short_shared_runs(spark):
    own, rnd = winnowing.Winnower(winnowing.K, winnowing.W), random.Random(5)
    run = winnowing.K + winnowing.W - 1
    assert run <= 20
    for _ in range(300):
        noise = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(80)))
        shared = "".join(rnd.choice("abcdefgh") for _ in range(run))
        a, b = (own.choose(noise() + shared + noise())[0].tolist() for _ in range(2))
        assert set(a) & set(b)
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = winnowing.op7_winnowing(spark, sf_dir).collect()
    assert any(2 * run <= r.n_chars < 160 for r in rows)
    for r in rows:
        assert r.fingerprint == winnowing.as_text(own.choose(texts[r.doc_id]))
        assert r.near_edited > 0 or r.n_chars < 2 * run
