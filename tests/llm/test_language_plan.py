"""Language identification: a plan that does not unfold, and the fused evidence against plain arithmetic."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowkeeper.llm import language


def model_of(n):
    rng = np.random.default_rng(n)
    shares = rng.dirichlet(np.ones(language.BUCKETS), n).T + 1e-9
    names = tuple(f"l{i:02}" for i in range(n - 1))
    return language.Likelihoods((*names, language.UNDETERMINED), np.log(shares))


DOCS = [(i, f"text number {i % 7} of many", f"h{i % 3}.example.{'org' if i % 2 else 'com'}") for i in range(40)]


def test_plan_grows_in_proportion_to_the_languages(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    lengths = {}
    for n in (5, 50):
        kept = language.documents_in_known_languages(docs, model_of(n))
        lengths[n] = len(kept._jdf.queryExecution().optimizedPlan().toString())
        assert kept.columns == docs.columns and kept.count() <= len(DOCS)
    assert lengths[50] <= 10 * lengths[5], lengths


def plain_scores(rows, model):
    """(language, confidence) per row of (text, host, declared), by the formulas of the module's description."""
    n = len(model.languages)
    own = []
    for text, _, _ in rows:
        t = model.of(text)
        e = np.exp(t - t.max())
        own.append((t, e / e.sum()))

    def site(host):
        return ".".join(host.split(".")[-2:])

    sums = defaultdict(lambda: np.zeros(n))
    for (text, host, declared), (_, p) in zip(rows, own):
        sums["all"] += p
        if host is not None:
            sums["host", host] += p
            sums["site", site(host)] += p
            if "." in host:
                sums["suffix", host.split(".")[-1]] += p
        if declared is not None:
            sums["declared", declared] += p
    whole = (sums["all"] + 1) / (sums["all"].sum() + n)
    found = []
    for (text, host, declared), (t, p) in zip(rows, own):
        if not text or not text.strip():
            found.append((language.UNDETERMINED, 0.0))
            continue

        def share(key, parent, weight):
            m = sums[key]
            return (m - p + weight * parent) / (m.sum() - 1 + weight)

        prior = whole
        if host is not None:
            prior = np.maximum(share(("host", host), share(("site", site(host)), whole, language.PARENT_ROWS), language.PARENT_ROWS), 1e-9)
        score = t + np.log(prior)
        for key, there in ((("declared", declared), declared is not None), (("suffix", host and host.split(".")[-1]), host is not None and "." in host)):
            if there:
                score = score + np.log(np.maximum(share(key, whole, language.EVIDENCE_ROWS), 1e-9) / whole)
        e = np.exp(score - score.max())
        e /= e.sum()
        found.append((model.languages[int(e.argmax())], float(e.max())))
    return found


def test_fused_evidence_agrees_with_plain_arithmetic(spark):
    """Declared language, suffix, host and site of a small table of pages; some of them, and some texts, are missing."""
    model = model_of(4)
    texts = ["one short text", "quite another one here", "and a third, ein dritter Text", "", None]
    hosts = ["a.example.org", "b.example.org", "c.other.com", "plain", None]
    declared = ["en", "de", None]
    rows = [(texts[i % 5], hosts[i % 4 if i % 9 else 4], declared[i % 3]) for i in range(60)]
    table = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "id long, text string, host string, said string")
    # Extra columns named like the steps' own do no harm.
    table = table.withColumns({"t": F.lit(1), "row": F.lit("x"), "_m": F.lit(2), "confidence_in": F.lit(3)})
    found = language.language_scores(table, model, ["id"], F.col("text"), host=F.col("host"), declared=F.col("said")).collect()
    want = plain_scores(rows, model)
    assert len(found) == 60
    for r in found:
        name, confidence = want[r.id]
        assert (r.language, r.kept) == (name, name != language.UNDETERMINED and confidence >= language.LEAST_CONFIDENCE), r
        assert r.confidence == pytest.approx(confidence, abs=1e-9) and not math.isnan(r.confidence)
