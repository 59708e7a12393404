import math
import random
import zlib

import numpy as np
import pytest

from tests.llm import cases
from worklog.llm import quality, url_filter


def prose(rnd, n):
    return " ".join(rnd.choice(["the", "of", "and", "house", "river", "stone", "walk", "green", "is", "was"]) + rnd.choice(["", "", "", ",", "."]) for _ in range(n))


def labelled(seed=1, n=400):
    rnd, docs, labels = random.Random(seed), [], []
    for i in range(n):
        good = rnd.random() < 0.7
        text = prose(rnd, rnd.randrange(20, 150))
        if not good:
            text = rnd.choice([text.upper() + "!!!", text.replace(" ", "### "), "word " * 80])
        docs.append((i, text, "a"))
        if rnd.random() < 0.8:
            labels.append((i, int(good), 0))
    return docs, labels


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = labelled()
    return docs, labels, quality.quality_scores(cases.frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()


def test_held_out_accuracy(scored):
    _, labels, got = scored
    want = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert len(held) > 40 and np.mean([r.predicted == want[r.doc_id] for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_model_matches_plain_numpy(spark):
    docs, labels = labelled(2, 150)
    x = {i: np.array(quality.statistics(t)) for i, t, _ in docs}
    rows = [(x[i].tolist(), q) for i, q, _ in labels]
    model = quality.fit(spark.createDataFrame(rows, "x array<double>, label int"))
    z = np.array([r[0] for r in rows])
    y = np.array([r[1] for r in rows])
    z = (z - z.mean(0)) / np.maximum(z.std(0), 1e-6)
    cov = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum(cov[c] * (y == c).mean() for c in (0, 1))
    density = []
    for c in (0, 1):
        s = 0.9 * cov[c] + 0.1 * pooled
        s = 0.98 * s + 0.02 * np.trace(s) / len(s) * np.eye(len(s))
        diff = z - z[y == c].mean(0)
        density.append(math.log((y == c).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ni,ij,nj->n", diff, np.linalg.inv(s), diff))
    want = np.clip(density[1] - density[0], -40, 40)
    assert np.allclose(model.log_ratio(np.array([r[0] for r in rows])), want, atol=1e-6)


def test_quality_of_awkward_tables(spark, scored):
    docs, labels, _ = scored
    frame = spark.createDataFrame(labels + [(5, None, 1), (None, 1, 0), (6, 7, 0)], "doc_id long, quality int, toxic int")
    data = docs + [(10_000 + i if r[0] is not None else None, r[1], r[2]) for i, r in enumerate(cases.rows())]
    got = quality.quality_scores(cases.frame(spark, data), frame).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
    assert all(not r.held_out for r in got if r.doc_id is None)
    kept = quality.keep_good(cases.frame(spark, data), frame)
    assert kept.columns == cases.frame(spark, []).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.predicted)
    none = quality.quality_scores(cases.frame(spark), frame.filter("quality = 1")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.quality_scores(cases.frame(spark, []), frame).collect() == []


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:end].translate({c: c + 32 for c in range(65, 91)}), rest[end:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    best = max(((h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), key=lambda r: len(r[0]), default=(None, None))
    return host, path, *best


URLS = [None, "", "no scheme", "http://", "http://A.ORG", "http://a.org/", "HTTP://www.Example.org/es/1?x=1", "http://example.org/en/17", "http://notexample.org/es/1", "http://borg/", "ftp://x.com/fr/a#b", "http://x.com/de/?a=1&b=2", "http://x.com?/de/", "http://x.com#/fr/", "a://b://c.com/de/x", "http://é.com/fr/Ü\nz", "x" * 5000, "http://" + "y" * 9000 + ".com/de/"]


def test_urls_match_brute_force(spark):
    rnd = random.Random(3)
    urls = URLS + [f"http://{rnd.choice(['www', 'm', 'casino-win', 'spam-farm'])}.site{rnd.randrange(30)}.{rnd.choice(['com', 'net', 'org'])}/{rnd.choice(['en', 'de', 'fr'])}/{rnd.randrange(99)}?q={rnd.randrange(9)}" for _ in range(400)]
    pages = spark.createDataFrame([(i, u, "html", "x", "x") for i, u in enumerate([*urls, *urls[:30]])], "page_id long, url string, html string, suffix string, features string")
    got = url_filter.judge(pages).collect()
    assert len(got) == len(urls) + 30
    by_url = {}
    for r in got:
        url = (urls + urls[:30])[r.page_id]
        host, path, rule, verdict = brute(url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
        assert by_url.setdefault(url, r.verdict) == r.verdict
    free = [(r.verdict == "block", any(w in r.host for w in url_filter.SEED_WORDS)) for r in got if r.rule is None and r.host]
    assert np.mean([a == b for a, b in free]) > 0.9


@pytest.mark.parametrize(("urls", "want"), [([], []), (["http://a.net/x"], ["allow"]), ([None, None], ["allow", "allow"]), (["http://casino.net/1", "http://casino.net/2"], ["block", "block"])])
def test_urls_of_one_verdict(spark, urls, want):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(pages).collect()] == want


def test_hosts_not_seen_in_training(spark):
    rnd = random.Random(9)
    page = lambda site: f"http://{rnd.choice(['www.', 'm.', ''])}{site}.example.{rnd.choice(['com', 'net'])}/{rnd.choice(['en', 'it'])}/{rnd.randrange(9999)}"
    plain = ["".join(rnd.choice("aeinrst") for _ in range(rnd.randrange(5, 10))) for _ in range(40)]
    bad = [f"{a}-{b}" for a, b in [("free", "bets"), ("casino", "win"), ("adult", "x"), ("spam", "farm")]]
    seen = [page(rnd.choice(plain[:30])) for _ in range(600)] + [page(rnd.choice(bad[:2])) for _ in range(30)]
    new = [page(rnd.choice(plain[30:])) for _ in range(200)] + [page(rnd.choice(bad[2:])) for _ in range(100)]
    labelled = spark.createDataFrame([(u, int(i >= 600)) for i, u in enumerate(seen)], "url string, blocked int")
    pages = spark.createDataFrame(list(enumerate(new)), "page_id long, url string")
    blocked = {r.page_id for r in url_filter.judge(pages, labelled, rules=[]).collect() if r.verdict == "block"}
    assert sum(i >= 200 for i in blocked) >= 80 and sum(i < 200 for i in blocked) <= 10


def test_features(spark):
    got = url_filter.with_features(spark.createDataFrame([("http://a-b.c.net/d/e1.html?x=1&y=2#z=3",), ("",), (None,)], "url string")).collect()
    r = got[0]
    assert (r.suffix, r.depth, r.parameters, r.hyphens, r.dots) == ("net", 2.0, 2.0, 1.0, 2.0)
    text = "http://a-b.c.net/d/e1.html?x=1&y=2#z=3"
    want = -sum(text.count(c) / len(text) * math.log2(text.count(c) / len(text)) for c in set(text))
    assert r.entropy == pytest.approx(want) and r.digit_ratio == pytest.approx(4 / len(text))
    assert [x.entropy for x in got[1:]] == [0.0, 0.0]


def test_suffixes_are_counted_over_all_rows(spark):
    rows = [(f"http://h{i}.s{i % 40}/p{i}", int(i % 40 < 10)) for i in range(400)]
    suffixes = {r.suffix: r for r in url_filter.train(spark.createDataFrame(rows, "url string, blocked int"), max_rows=30)[1].collect()}
    assert len(suffixes) == 40
    for i in range(40):
        assert suffixes[f"s{i}"].suffix_seen == pytest.approx(10 / 400)
        assert suffixes[f"s{i}"].suffix_blocked == pytest.approx((11 if i < 10 else 1) / 12)


def test_copies_of_a_url_are_one_training_row(spark, monkeypatch):
    fitted = []

    class Trees:
        def __init__(self, **_):
            pass

        def fit(self, rows):
            fitted.extend(rows.collect())

    monkeypatch.setattr(url_filter, "GBTClassifier", Trees)
    rows = [(f"http://h{i}.com/p{i}", i % 2) for i in range(200)]
    for i, url in enumerate(["http://often.com/", "http://often.net/", "http://often.org/"]):
        rows += [(url, i % 2)] * 200
    url_filter.train(spark.createDataFrame(rows, "url string, blocked int"))
    assert sorted(r.copies for r in fitted) == [1.0] * 200 + [200.0] * 3
