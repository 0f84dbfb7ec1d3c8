import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm.maxent_lm import CLASSES, END, NONE, PLACES, SEGMENT, Batch, fit_lm, lm_scores, rows_for, segments_of, tokens_of


@pytest.mark.parametrize("top", [1 << 18, 50])
def test_counts_base_and_gain(spark, docs, top):
    rng = random.Random(5)
    tongues = [[f"{a}{b}{c}" for a in x for b in "aeiou" for c in ("n", "rt", "s")] for x in ("bdfg", "klmp")]
    extra = [(5000 + k, " ".join(rng.choice(tongues[k % 2]) for _ in range(150))) for k in range(200)]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in frame.collect()]
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold)), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total, round(sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens(t)), 5)) for i, t in rows)
    got = lm_scores(frame, top=top).collect()
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert [h[:5] for h in have] == [w[:5] for w in want]
    assert [h[5] for h in have] == pytest.approx([w[5] for w in want], abs=1e-4)
    unseen = [r for r in got if r.held_out and (r.doc_id or 0) >= 5000]
    assert unseen and sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    assert all(r.score < 0 for r in got)


def chains(spark):
    rng = random.Random(6)
    words = [f"b{a}{b}{c}n" for a in "aeiou" for b in "bdfgk" for c in "aeiou"]
    follow = dict(zip(words, rng.sample(words, len(words)), strict=True))

    def chain():
        w = [rng.choice(words)]
        while len(w) < 60:
            w.append(follow[w[-1]])
        return " ".join(w)

    return spark.createDataFrame([(k, chain()) for k in range(300)], "doc_id long, text string").cache()


def test_previous_word_tells_words_of_a_class_apart(spark):
    got = lm_scores(chains(spark)).where("held_out").collect()
    assert got and sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)  # words of a class follow each other by a fixed rule


def naive_score(model, counts, text):
    """The score of a text, token by token, in plain Python over all words' places."""
    vocabulary, (first, second) = model.vocabulary, model.vocabulary.biases()
    rows = len(model.weights[0])
    mix = lambda key, j: int(Batch._row(np.array([key], np.uint64), j, np.uint64(64 - (rows.bit_length() - 1)), np.uint32)[0])
    total, seen = 0.0, []
    fold = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode()
    for w in [*re.findall(rb"[^\x20\x09-\x0D]+", fold), END]:
        from xxhash import xxh3_64_intdigest

        k = vocabulary.index.get(w)
        cls, place = (int(vocabulary.cls[k]), int(vocabulary.place[k])) if k is not None else (int(x[0]) for x in vocabulary.far([w]))
        back = lambda n: seen[-n] if len(seen) >= n else (int(NONE), CLASSES, CLASSES * PLACES)
        (n1, c1, l1), (n2, c2, l2), (_, c3, _) = back(1), back(2), back(3)
        own = (cls + 1) * 0x9FB21C651E98DF25 % 2**64
        keys = [n1, c1 * 64 + c2, n2, c1 * 64 + c3], [n1 ^ own, (c1 * 64 + c2) ^ own, n2 ^ own, (l1 * 65536 + l2) ^ own]
        p = 1.0
        for weights, bias, ks, j, target in ((model.weights[0], first, keys[0], 0, cls), (model.weights[1], second[cls], keys[1], 4, place)):
            z = [float(b) + sum(float(weights[mix(key, j + i), c]) for i, key in enumerate(ks)) for c, b in enumerate(bias)]
            p *= math.exp(z[target]) / sum(map(math.exp, z))
        total += math.log10(p * (counts[w] + 1) / vocabulary.mass[cls, place])
        seen.append((k if k is not None else xxh3_64_intdigest(w), cls, cls * PLACES + place))
    return total


@pytest.mark.parametrize("top", [1 << 18, 40])
def test_scores_against_brute_force(spark, docs, top):
    frame = chains(spark).where("doc_id < 60").unionByName(docs.select("doc_id", "text").where("doc_id in (1, 2, 8, 101, 201, 300) or doc_id is null"))
    training = frame.where("doc_id % 7 < 5 or doc_id is null")
    model = fit_lm(training, top=top, rows=1 << 10)
    counts = Counter(w for r in training.collect() for w in tokens_of(r.text))
    # the words of a place, and the unknown one, share its mass: the model sums to one over all words
    mass = np.zeros((CLASSES, PLACES))
    for w, c in counts.items():
        k = model.vocabulary.index.get(w)
        at = (model.vocabulary.cls[k], model.vocabulary.place[k]) if k is not None else tuple(x[0] for x in model.vocabulary.far([w]))
        mass[at] += c + 1
    unknown = model.vocabulary.mass - mass
    assert set(np.unique(unknown.round(6))) == {0.0, 1.0}
    assert any(w.any() for w in model.weights)
    got = sorted(((r.doc_id or -1, round(r.score, 6)) for r in lm_scores(frame, model=model).collect()))
    want = sorted((r.doc_id or -1, naive_score(model, counts, r.text)) for r in frame.collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], rel=1e-4)


def test_segments_join_to_the_whole_text():
    rng = random.Random(9)
    text = "".join(rng.choice(["a", "bc", " ", "\n", "Ü", "longer"]) for _ in range(4000))
    whole = [*text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split(), END]
    for step in (1, 7, 500):
        assert [w for words in segments_of(text, step) for w in words] == whole
    assert tokens_of("x" * (2 * SEGMENT) + "  ")[-1] == END and tokens_of(None) == [END] and len(tokens_of("y " * SEGMENT)) == SEGMENT + 1


def test_a_long_text_scores_as_its_segments_do(spark):
    text = " ".join(["alpha beta gamma delta"] * 60_000)  # beyond a segment
    frame = spark.createDataFrame([(3, text), (8, "alpha beta")], "doc_id long, text string")
    model = fit_lm(frame, rows=1 << 10)
    counts = Counter(w for t in (text, "alpha beta") for w in tokens_of(t))
    row = lm_scores(frame, model=model).where("doc_id = 3").first()
    assert row.n_tokens == row.n_known == 240_001
    part = lambda n: " ".join(["alpha beta gamma delta"] * n)
    short, longer = (r.score for r in lm_scores(spark.createDataFrame([(1, part(50)), (2, part(100))], "doc_id long, text string"), model=model).orderBy("doc_id").collect())
    assert short == pytest.approx(naive_score(model, counts, part(50)), rel=1e-4)
    assert row.score == pytest.approx(short + (longer - short) / 50 * (60_000 - 50), rel=1e-3)  # nothing is lost where segments meet


def test_rows_grow_with_the_vocabulary():
    assert [rows_for(k) for k in (0, 1 << 20, 1 << 24, 1 << 40)] == [1 << 16, 1 << 16, 1 << 17, 1 << 18]


def test_repeated_rows_and_clashing_columns(docs, rows_of):
    got = lm_scores(docs).collect()  # rid, word and other names of the operator's own are columns of the table
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows_of)


def test_nothing(empty):
    assert lm_scores(empty).count() == 0
