import itertools
import random

import numpy as np

from docsmith.llm import quality_model as q
from docsmith.llm import queries


def corpus(n=900, seed=5):
    rng = random.Random(seed)
    words = ["the", "of", "and", "house", "river", "green", "walks", "in", "to", "is", "table", "morning", "paper", "under", "letters", "with"] + ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(400)]
    weights = [12] * 16 + [1] * 400
    rows = []
    for i in range(n):
        w = rng.choices(words, weights, k=rng.randint(30, 200))
        text = "\n".join(" ".join(w[k : k + 12]).capitalize() + "." for k in range(0, len(w), 12))
        kind = i % 6 if i % 6 < 4 else 9
        if kind == 0:
            text = " ".join(x + rng.choice(["***", "$$$", "###"]) for x in text.split())
        elif kind == 1:
            text = " ".join(x.upper() + "!!" for x in text.split())
        elif kind == 2:
            text = " ".join(" ".join([x] * 12) for x in text.split()[:20])
        rows.append((i, text, int(kind > 2)))
    return rows


def test_held_out_accuracy_and_defined_cases(spark):
    rows = corpus()
    extra = [(10_000, "", 0), (10_001, None, 0), (10_002, " \n ", 0), (10_003, "Short one.", 1), (10_004, "word " * 30000, 0)]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows + extra], "doc_id long, text string, score string").repartition(3)
    got = {r.doc_id: r for r in q.classify(df, sample=300).collect()}
    assert len(got) == len(rows) + len(extra)
    assert np.mean([got[i].kept == bool(good) for i, _, good in rows]) > 0.97
    assert all(got[i].kept for i, _, good in rows if good)
    assert not any(got[i].kept for i in (10_000, 10_001, 10_002)) and got[10_000].score == 0
    again = {r.doc_id: r for r in q.classify(df.repartition(5), sample=300).collect()}
    assert all(abs(got[i].score - again[i].score) < 1e-9 for i in got)


def test_em_finds_planted_accuracies():
    rng = np.random.default_rng(3)
    n, right = 40_000, np.array([0.9, 0.8, 0.85, 0.7])
    good = rng.random(n) < 0.8
    votes = np.where(rng.random((n, 4)) < np.where(good[:, None], 0.999, right), np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    votes[rng.random((n, 4)) < 0.2] = 0
    patterns = np.array(list(itertools.product((-1, 0, 1), repeat=4)))
    code = (votes + 1) @ 3 ** np.arange(3, -1, -1)
    posterior, prior, rates = q.fit_votes(patterns, np.bincount(code, minlength=81))
    assert abs(prior - 0.8) < 0.03
    assert np.abs(1 - rates[0] - right).max() < 0.05
    assert np.mean((posterior[code] > 0.5) == good) > 0.97


def test_em_finds_a_labeller_that_errs_often():
    rng = np.random.default_rng(8)
    n = 40_000
    good = rng.random(n) < 0.8
    # the share of good and of bad texts that each labeller calls bad
    on_good, on_bad = np.array([0.3, 0.02, 0.05, 0.1, 0.0]), np.array([0.8, 0.9, 0.7, 0.85, 0.6])
    votes = np.where(rng.random((n, 5)) < np.where(good[:, None], on_good, on_bad), -1, 1)
    votes[rng.random((n, 5)) < 0.1] = 0
    patterns = np.array(list(itertools.product((-1, 0, 1), repeat=5)))
    code = (votes + 1) @ 3 ** np.arange(4, -1, -1)
    posterior, prior, rates = q.fit_votes(patterns, np.bincount(code, minlength=3**5))
    assert abs(prior - 0.8) < 0.03
    assert np.abs(1 - rates[1] - on_good).max() < 0.05 and np.abs(1 - rates[0] - on_bad).max() < 0.05
    assert np.mean((posterior[code] > 0.5) == good) > 0.95


def test_equal_and_null_ids_are_sampled(spark):
    rows = corpus(240)
    df = spark.createDataFrame([(None if i % 2 else 7, t) for i, t, _ in rows], "doc_id long, text string")
    got = {}
    for text, r in zip([t for _, t, _ in rows], q.classify(df.coalesce(1), sample=60).collect()):
        got[text] = r.kept
    assert np.mean([got[t] == bool(g) for _, t, g in rows]) > 0.95
    alone = spark.createDataFrame([(1, rows[5][1])] * 500, "doc_id long, text string")
    assert q.classify(alone, sample=3).select("kept").distinct().count() == 1


def test_registered_query_on_held_out_labels(spark):
    kept = {r.doc_id: r.kept for r in queries.op3_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    good = [kept[r.doc_id] for r in labels if r.quality == 1]
    bad = [kept[r.doc_id] for r in labels if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05


def test_empty_table(spark):
    assert q.classify(spark.createDataFrame([], "doc_id long, text string")).count() == 0
