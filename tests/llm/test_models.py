"""Interpolation, language ID, quality and URL filtering against brute force and held-out accuracy."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from emberframe.llm import interpolation, language, quality, url_filter
from emberframe.session import table

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII)), None]  # None: the end


def brute_base(rows):
    of = lambda i: zlib.crc32(b"" if i is None else str(i).encode())
    counts = Counter(t for i, text in rows if of(i) % 7 != 2 for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    return sorted(
        ((str(i), of(i) % 7 == 2, len(own := tokens(text)), sum(counts[t] > 0 for t in own), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), 4)) for i, text in rows), key=str
    )


@pytest.mark.parametrize("name", ["awkward", "given"])
def test_interpolation(spark, docs, small, name):
    source = docs if name == "awkward" else table(spark, small, "documents")
    rows = [(r.doc_id, r.text) for r in source.collect()]
    found = interpolation.score(source).collect()
    assert sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found), key=str) == brute_base(rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    if name == "given":  # the model predicts held-out texts better than single words do
        held = [r for r in found if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_interpolation_of_nothing(no_docs):
    assert interpolation.score(no_docs).collect() == []


def test_weights_follow_the_evidence():
    cells = np.zeros((interpolation.BUCKETS, interpolation.LEVELS, interpolation.LEVELS), dtype=np.int64)
    cells[0, interpolation.LEVELS - 1, 4] = 1000  # unseen contexts: only the word estimate speaks
    cells[9, 2, 30] = 1000  # frequent contexts: the bigram estimate is far higher
    weights = interpolation.learn_weights(cells.ravel(), 1e-6)
    assert np.allclose(weights.sum(axis=1), 1)
    assert weights[0].argmax() == 1 and weights[9].argmax() == 0


def test_languages(spark, small, docs, no_docs):
    given, pages = table(spark, small, "documents"), table(spark, small, "pages")
    rows = language.identify(given, pages).collect()
    assert len(rows) == given.count() + pages.count()
    truth = {r.doc_id: r.lang for r in given.select("doc_id", "lang").collect()}
    judged = [r for r in rows if r.doc_id is not None and truth[r.doc_id] and r.kept]
    assert sum(r.lang == truth[r.doc_id] for r in judged) >= 0.95 * len(judged)
    assert len(judged) >= 0.9 * len(truth)
    odd = language.identify(docs, pages.limit(0)).collect()
    assert len(odd) == docs.count()
    assert {r.lang for r in odd if r.doc_id in (1, 2, 3)} == {"und"}
    assert language.identify(no_docs, pages.limit(0)).collect() == []
    assert {r.kept for r in language.identify(no_docs, pages).collect()} == {True}


def test_other_text_is_rejected_and_every_label_modelled(spark):
    given = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang", "source")
    rng = np.random.default_rng(1)
    other = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью. " * 3, "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。" * 3,
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto. " * 3, rng.bytes(300).hex(), "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 500)),
    ]
    rows = [(-1 - i, text, None, None) for i, text in enumerate(other)]
    found = {r.doc_id: r for r in language.identify(given.union(spark.createDataFrame(rows, given.schema)), table(spark, "/root/testdata/sf0.001", "pages").limit(0)).collect()}
    assert {(found[-1 - i].lang, found[-1 - i].kept) for i in range(len(other))} == {("und", False)}
    assert sum(found[r.doc_id].kept for r in given.where("lang IS NOT NULL").collect()) >= 0.98 * given.where("lang IS NOT NULL").count()
    many = spark.createDataFrame([(f"text {i}", f"x{i:02}") for i in range(70)], "text string, lang string")
    assert len(language.train(many)[0]) == 70


def test_priors_shrink_towards_wider_levels(spark):
    rows = [(f"a.x.org", "x.org", "org", 0)] * 50 + [("b.x.org", "x.org", "org", 0)] + [("c.net", "c.net", "net", 1)] * 5
    priors = {r.host: r.prior for r in language.host_priors(spark.createDataFrame(rows, "host string, domain string, suffix string, seen int"), ["de", "en"]).collect()}
    assert all(abs(sum(p) - 1) < 1e-9 for p in priors.values())
    assert priors["a.x.org"][0] > priors["b.x.org"][0] > 0.5 > priors["c.net"][0]


def test_quality(spark, docs, no_docs):
    folder = "/root/testdata/sf0.01"
    given, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.score_quality(given, labels).collect()
    assert len(rows) == given.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) >= 0.8 * len(good) * len(bad)
    odd = quality.score_quality(docs, labels.limit(0)).collect()
    assert len(odd) == docs.count() and {r.score for r in odd} == {0.5}
    assert quality.score_quality(no_docs, labels).collect() == []


def test_url_rules_and_parts(spark):
    urls = [
        ("HTTP://EXAMPLE.COM/en/a?x", "example.com", "/en/a", "example.com/en/", "block"), ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://other.com", "other.com", "", None, None), ("http://other.com/", "other.com", "/", "com/", "allow"), ("x://a.net/es/q#z", "a.net", "/es/q", "net/es/", "block"),
        ("x://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), ("x://example.com?q=/en/", "example.com", "", None, None), ("no host", "", "", None, None), (None, "", "", None, None),
        ("y://\u00c4.net/fr/", "\u00c4.net", "/fr/", "net/fr/", "block"), ("a://b://c.com/", "b:", "//c.com/", None, None),
    ]
    frame = spark.createDataFrame([(i, u[0], "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    found = {r.page_id: r for r in url_filter.filter_urls(frame).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, rule)
        assert found[i].verdict == verdict if verdict else found[i].verdict in ("allow", "block")
    assert url_filter.filter_urls(frame.limit(0)).collect() == []
    alone = url_filter.filter_urls(frame.where("page_id = 8")).first()
    assert (alone.verdict, alone.difference) == ("allow", 0.0)


def test_url_model_tells_kinds_apart(spark):
    rows = [(i, f"http://site{i % 7}.com/recipes/{i}/cake") for i in range(300)] + [(1000 + i, f"http://q{i % 5}.net/es/xx-casino-{i}") for i in range(300)]
    rows += [(5000 + i, f"http://fresh.org/recipes/{i}/cake") for i in range(20)] + [(6000 + i, f"http://fresh.org/xx-casino-{i}") for i in range(20)]
    found = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert sum(found[5000 + i] == "allow" for i in range(20)) >= 18
    assert sum(found[6000 + i] == "block" for i in range(20)) >= 18


def test_url_model_reads_the_query_and_urls_without_scheme(spark):
    rows = [(i, f"http://site{i % 7}.com/go?recipe=cake-{i}") for i in range(300)] + [(1000 + i, f"http://q{i % 5}.net/es/go?xx=casino-{i}") for i in range(300)]
    rows += [(5000, "http://fresh.org/go?recipe=cake-7"), (5001, "http://fresh.org/go?xx=casino-7"), (5002, "recipe=cake-8"), (5003, "xx=casino-8")]
    found = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [found[5000 + i].verdict for i in range(4)] == ["allow", "block", "allow", "block"]
    assert found[5000].host == "fresh.org" and found[5000].path == "/go" and found[5002].host == ""


def test_url_ratio_against_brute_force(spark):
    """Counts are exact: the ratio of 200 URLs from dictionaries, and the same verdicts for the table ten times over."""
    from collections import Counter
    from math import log

    urls = [f"http://site{i % 7}.com/a/{i * 7919 % 1000}?q={i}" for i in range(120)] + [f"http://q{i % 5}.net/es/x{i * 31 % 97}-\u00e9" for i in range(60)] + [f"http://neu{i}.org/a/x{i}" for i in range(20)]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(5)
    found = {r.page_id: r for r in url_filter.filter_urls(frame).collect()}
    counts = {kind: Counter() for kind in ("allow", "block")}
    text = lambda u: [None] * 4 + list(u.encode())
    for i, u in enumerate(urls):
        if found[i].rule and zlib.crc32(u.encode()) % 5:
            raw = text(u)
            for at in range(4, len(raw)):
                for order in range(5):
                    counts[found[i].verdict][tuple(raw[at - order : at + 1])] += 1
                    counts[found[i].verdict]["context", tuple(raw[at - order : at])] += 1
    for i, u in enumerate(urls):
        raw, logs = text(u), {}
        for kind, c in counts.items():
            total = 0.0
            for at in range(4, len(raw)):
                p = 1 / 256
                for order in range(5):
                    p = (c[tuple(raw[at - order : at + 1])] + 2.0 * p) / (c["context", tuple(raw[at - order : at])] + 2.0)
                assert 0 < p <= 1
                total += log(p)
            logs[kind] = total
        assert abs(found[i].difference - (logs["allow"] - logs["block"]) / (len(raw) - 4)) < 1e-9
    ten = frame
    for _ in range(9):
        ten = ten.unionByName(frame)
    again = {r.page_id: r.verdict for r in url_filter.filter_urls(ten).collect()}
    assert again == {i: r.verdict for i, r in found.items()}
