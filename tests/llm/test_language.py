import re

import numpy as np
import pytest

from wavelake.llm.language import identify, op4_language, text_model
from wavelake.llm.wrappers import host_of

from .conftest import SF


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text")


def test_languages_of_pages(spark):
    rows = op4_language(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    right = [re.search(r"/(en|fr|de|es)/", r.url)[1] == r.lang for r in rows]
    assert np.mean(right) > 0.98 and all(0 < r.probability <= 1 for r in rows)


def test_posteriors_against_plain_sums(spark, docs):
    """All pages' posteriors worked out one by one, from the text model's probabilities."""
    from collections import Counter, defaultdict

    from wavelake.llm import language as L

    langs, logs = text_model(docs)
    counts = {k: Counter() for k in langs}
    for r in docs.collect():
        if r.lang is not None and r.text is not None:
            counts[r.lang].update(L._grams(np.frombuffer(r.text.encode(), np.uint8)).tolist())
    for k, row in zip(langs, logs, strict=True):
        total = sum(counts[k].values()) + L.SMOOTH * (1 << L.BITS)
        assert np.allclose(row[:500], [np.log((counts[k][c] + L.SMOOTH) / total) for c in range(500)])
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    n, known = len(langs), []
    for r in pages:
        cells = L._grams(np.frombuffer(L.visible_text(r.html).encode(), np.uint8))
        t = logs[:, cells].mean(1) * min(len(cells), L.DISCOUNT * len(cells) ** 0.5)
        p = np.exp(t - np.logaddexp.reduce(t))
        host = re.match(r"https?://([^/?#:]*)", r.url)[1].lower()
        domain, suffix = re.search(r"([^.]+\.[^.]+)$", host), re.search(r"\.([a-z]+)$", host)
        m = L._DECLARED.search(r.html)
        known.append((r.page_id, p, {"host": host, "domain": domain and domain[1], "suffix": suffix and suffix[1], "declared": (m[1] or m[2]).lower() if m else None}))
    sums = defaultdict(lambda: np.zeros(n))
    for _, p, keys in known:
        for k, v in keys.items():
            sums[k, v] += p
        sums["all"] += p
    values = {k: len({keys[k] for _, _, keys in known} - {None}) for k in ("declared", "suffix")}
    found = {r.page_id: r for r in op4_language(spark, SF).collect()}
    for i, p, keys in known:
        prior = (sums["all"] - p + 1) / (sums["all"].sum() - 1 + n)
        for k, weight in (("domain", L.DOMAIN_WEIGHT), ("host", L.HOST_WEIGHT)):
            others = np.maximum(sums[k, keys[k]] - p, 0) if keys[k] is not None else np.zeros(n)
            prior = (others + weight * prior) / (others.sum() + weight)
        score = np.log(p) + np.log(prior)
        for k in ("declared", "suffix"):
            if keys[k] is not None:
                score = score + np.log((np.maximum(sums[k, keys[k]] - p, 0) + L.VALUE_WEIGHT / values[k]) / (sums["all"] - p + L.VALUE_WEIGHT))
        share = np.exp(score - np.logaddexp.reduce(score))
        assert found[i].lang == langs[int(share.argmax())] and found[i].probability == pytest.approx(share.max(), rel=1e-6)


def test_other_evidence_decides_where_text_is_silent(spark, docs):
    german = "<html lang='de'><p>der die das und ist nicht einer Verkehr schlichte Einheit unter"
    rows = [(i, f"http://a{i % 3}.web.de/{i}", german) for i in range(40)] + [(100, "http://a1.web.de/x", "<html lang=de>"), (101, "http://new.web.de/", ""), (102, "http://other.fr", "<html lang=fr>"), (103, None, None)]
    found = {r.page_id: r for r in identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert found[0].lang == "de" and found[100].lang == "de" and found[100].probability > found[101].probability > 0.5
    assert found[100].text_probability == pytest.approx(0.25) and len(found) == 44


def test_model_is_a_distribution(docs):
    langs, logs = text_model(docs)
    assert langs == ["de", "en", "es", "fr"] and np.exp(logs).sum(1) == pytest.approx(np.ones(4))


def test_hosts(spark):
    urls = ["http://A.b.com:80/x?y", "https://u:p@c.org", "//d.net/e", "plain", "", None]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(host_of()).collect()] == ["a.b.com", "c.org", "d.net", "plain", "", ""]


def test_odd_rows(spark, docs):
    rows = [(None, None, None, 1), (None, None, None, 1), (2, "", "", 2), (3, "x", "<p>" + "the of and " * 20_000, 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, lang int")
    assert identify(pages, docs).count() == 4 and identify(pages.limit(0), docs).count() == 0
    assert all(r.lang is None for r in identify(pages, docs.limit(0)).collect())
