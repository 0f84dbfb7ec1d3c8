import random

import numpy as np
import pytest

from tidemark.llm.calibration import calibrated, isotonic
from tidemark.llm.quality import drop_poor, quality_scores, statistics
from tidemark.llm.toxicity import FEATURES, NEAR, Features, Trees, toxicity_scores, undone

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("n", "r", "st", "l")]
    docs, labels = [], []
    for k in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        toxic, poor = k % 5 == 0, k % 4 == 0
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["zumpkin", "Zumpkins!", "you grobble", "GROBBLE"]))
        if poor:
            text = [w + "***" for w in text]
        docs.append((k, " ".join(text)))
        labels.append((k, int(not poor), int(toxic)))
    docs += [(1000, None), (1001, ""), (None, "text"), (3, "again"), (1002, "w " * 60_000)]
    labels += [(5, None, None), (None, 1, 1), (7, 1, 0), (9999, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string").cache(), spark.createDataFrame(labels, LABELS).cache()


def accuracy(scored, labels, label):
    truth = {r.doc_id: r[label] for r in labels.collect()}
    held = [(r.score >= 0.5, truth[r.doc_id]) for r in scored.collect() if r.held_out and truth.get(r.doc_id) is not None]
    return len(held), sum(a == b for a, b in held) / len(held)


@pytest.mark.parametrize(("score", "label"), [(quality_scores, "quality"), (toxicity_scores, "toxic")])
def test_held_out_accuracy(spark, labelled, score, label):
    docs, labels = labelled
    scored = score(docs, labels).cache()
    assert scored.count() == docs.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    n, right = accuracy(scored, labels, label)
    assert n > 100 and right > 0.95


@pytest.mark.parametrize("score", [quality_scores, toxicity_scores])
def test_without_labels_or_rows(spark, labelled, empty, score):
    docs, labels = labelled
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in score(docs.limit(5), none).collect()} == {0.5}
    assert score(empty, labels).count() == 0


@pytest.mark.parametrize("score", [quality_scores, toxicity_scores])
def test_clashing_columns_nulls_and_repeats(docs, labelled, rows_of, score):
    got = score(docs, labelled[1]).collect()  # x, y, score-like and other names of the operators' own are columns of the table
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows_of)
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got) and not any(r.held_out for r in got if r.doc_id is None)


def test_filter_keeps_columns(docs, spark, labelled):
    out = drop_poor(docs, labelled[1])
    assert out.columns == docs.columns


@pytest.mark.parametrize("name", [None, 5000])
def test_only_the_poor_row_of_an_identifier_goes(spark, labelled, name):
    docs, labels = labelled
    clean, poor = (docs.where(f"doc_id = {k}").first().text for k in (1, 4))
    more = docs.where("doc_id is not null").union(spark.createDataFrame([(name, clean), (name, poor)], "doc_id long, text string"))
    kept = drop_poor(more, labels)
    assert [r.text for r in kept.where(f"doc_id <=> {'null' if name is None else name}").collect()] == [clean]


def test_statistics_of_odd_texts():
    for text in (None, "", " ", "\ud800", "a" * 10_000, "| | |\n\n| |"):
        assert np.isfinite(statistics(text)).all()


def test_isotonic_is_monotone_and_close():
    rng = np.random.default_rng(0)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x))).astype(float)
    p = calibrated(isotonic(x, y), np.linspace(-3, 3, 200))
    assert (np.diff(p) >= 0).all() and np.abs(p - 1 / (1 + np.exp(-2 * np.linspace(-3, 3, 200)))).mean() < 0.04


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3)).astype(float)
    assert ((Trees().fit(x, y).margin(x) > 0) == (y > 0)).mean() > 0.98


def test_disguises_are_undone():
    assert [undone(w) for w in ("1d10t", "st*pid", "c.l.o.w.n", "looooser", "$tup1d")] == ["idiot", "stpid", "clown", "loser", "stupid"]


@pytest.mark.parametrize(("hits", "spoken", "other"), [(3, 2, 30), (2100, 2000, 40_000), (6000, 500, 60_000), (50, 0, 500), (0, 50, 500)])
def test_nearness_covers_whole_texts(hits, spoken, other):
    words = ["grobble"] * hits + ["you"] * spoken + ["plain"] * other
    random.Random(hits).shuffle(words)
    at = {k for k, w in enumerate(words) if w == "you"}
    want = sum(w == "grobble" and any(p in at for p in range(k - NEAR, k + NEAR + 1)) for k, w in enumerate(words))
    assert Features({"=grobble": 3.0}).of(" ".join(words))[FEATURES.index("near_second_person")] == want


def test_sample_is_bounded_and_repeatable(spark, labelled):
    from tidemark.llm.calibration import labelled_sample

    docs, labels = labelled
    everything = {tuple(r) for r in labelled_sample(docs, labels, "toxic", 10_000).collect()}
    some = [{tuple(r) for r in labelled_sample(docs.repartition(n), labels, "toxic", 200).collect()} for n in (1, 5)]
    assert some[0] == some[1] < everything and 100 < len(some[0]) <= 200
