"""Toxicity classifier: gradient-boosted trees on dense features, with isotonic calibration.

1. A bounded sample of labelled rows (``fit_rows``) is halved by identifier.
2. Each half yields a lexicon, and both together the final one: words and word beginnings that are much more frequent
   in toxic texts, counted by Spark over distinct texts.  Every entry that passes is kept; as each stands in several of
   the sample's texts, the sample's bound bounds their number.
3. Dense features of a text: densities of lexicon entries, their strength, their nearness to words of the second
   person, capitals, punctuation, obfuscated spellings and entries that only show once a spelling is undone.
4. Trees are fitted on features that saw each half through the other half's lexicon; scores from trees that have not
   seen a row's fold calibrate the isotonic map.
5. Every whole text is scored in one pass.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import calibrated, fold_of, held_out, isotonic, labelled_sample
from .shared import ship, stage

#: Words of the second person in English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi vous votre ton ta tú ti tu usted vosotros su".split())
#: Signs that stand for letters in disguised words.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"})
PREFIXES = (4, 5, 6)
NEAR = 4
FEATURES = ("hits", "hit_density", "strength", "strength_density", "strongest", "kinds", "near_second_person", "second_person", "capitals", "shouted", "shouted_hits", "punctuation", "exclamations", "obfuscated", "obfuscated_hits", "stretched", "log_words", "symbols")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_INSIDE = re.compile(r"[\W\d_]")
_STRETCH = re.compile(r"(.)\1{2,}")
_CACHED = 300_000


def bare(word: str) -> str:
    """A word in small letters without signs at its ends."""
    return _EDGES.sub("", word).lower()


def undone(word: str) -> str:
    """The letters that a disguised spelling stands for."""
    return _STRETCH.sub(r"\1", re.sub(r"[\W\d_]", "", word.lower().translate(LOOKALIKES)))


def entries_of(word: str) -> list[str]:
    """What of a bare word a lexicon may hold: the word, and its beginnings."""
    return [f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)] if word else []


def close_to(places: list[int], others: list[int], reach: int = NEAR) -> int:
    """How many of the sorted ``places`` have one of the sorted ``others`` at most ``reach`` away."""
    if not places or not others:
        return 0
    at, of = np.array(places), np.array(others)
    right = np.searchsorted(of, at)
    left, right = of[np.maximum(right - 1, 0)], of[np.minimum(right, len(of) - 1)]
    return int((np.minimum(np.abs(at - left), np.abs(at - right)) <= reach).sum())


class Features:
    """Dense features under a lexicon; remembers a bounded number of words."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = lexicon, {}

    def _word(self, word: str) -> tuple[float, bool, bool, bool, bool, bool]:
        """strength, second person, shouted, obfuscated, found only once undone, stretched"""
        plain = bare(word)
        strength = max((self.lexicon.get(e, 0.0) for e in entries_of(plain)), default=0.0)
        hidden, odd = False, len(plain) > 2 and bool(_INSIDE.search(plain)) and any(c.isalpha() for c in plain)
        stretched = bool(_STRETCH.search(plain))
        if not strength and (odd or stretched or (plain and plain != word.lower())):
            strength = max((self.lexicon.get(e, 0.0) for e in entries_of(undone(word.rstrip(".,;:?!|"))) if e[0] == "="), default=0.0)
            hidden = strength > 0
        return strength, plain in SECOND_PERSON, len(plain) > 2 and word.isupper(), odd, hidden, stretched

    def of(self, text: str | None) -> list[float]:
        words = (text or "").split()
        known = self.known
        if len(known) > _CACHED:
            known.clear()
        facts = []
        for w in words:
            f = known.get(w)
            if f is None:
                f = known[w] = self._word(w)
            facts.append(f)
        n = max(1, len(words))
        hit = [k for k, f in enumerate(facts) if f[0]]
        spoken = [k for k, f in enumerate(facts) if f[1]]
        near = close_to(hit, spoken)
        total = sum(facts[k][0] for k in hit)
        raw = np.bincount(np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8), minlength=256)
        letters, size = max(1, raw[65:91].sum() + raw[97:123].sum()), max(1, raw.sum())
        return [
            float(len(hit)), 1000 * len(hit) / n, total, 1000 * total / n, max((facts[k][0] for k in hit), default=0.0), float(len({bare(words[k]) for k in hit})),
            float(near), 1000 * len(spoken) / n, raw[65:91].sum() / letters, sum(f[2] for f in facts) / n, float(sum(facts[k][2] for k in hit)),
            sum(raw[c] for c in b".,;:?'\"()-") / size, raw[33] / size, sum(f[3] for f in facts) / n, float(sum(facts[k][4] for k in hit)),
            sum(f[5] for f in facts) / n, math.log1p(len(words)), sum(raw[c] for c in b"*&%$#@^~|") / size,
        ]


def learn_lexicons(sample: DataFrame, least_texts: int = 4, least_odds: float = 3.0) -> list[dict[str, float]]:
    """Entries that speak for label 1, with their log odds: from half 0, from half 1 and from all of ``sample``.

    ``sample`` has ``text, y, half``; equal texts count once.  One counting pass serves all three lexicons.
    """

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            entries, kinds = [], []
            for text, y, half in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = {e for w in {bare(x) for x in (text.as_py() or "").split()} for e in entries_of(w)}
                entries += own
                kinds += [2 * half + y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), pa.array(kinds, pa.int32())], ["entry", "kind"])

    texts = sample.groupBy("text").agg(F.max("y").alias("y"), F.min("half").alias("half"))
    kinds = [F.count_if(2 * F.col("half") + F.col("y") == k) for k in range(4)]
    totals = texts.agg(*kinds).first()
    counted = texts.mapInArrow(work, "entry string, kind int").groupBy("entry").agg(*(F.count_if(F.col("kind") == k).alias(f"k{k}") for k in range(4)))
    found = []
    for halves in ((0,), (1,), (0, 1)):
        p, n = (sum((F.col(f"k{2 * h + y}") for h in halves), F.lit(0)) for y in (1, 0))
        tp, tn = (sum(totals[2 * h + y] or 0 for h in halves) for y in (1, 0))
        odds = F.log((p + 0.5) / (tp + 1.0)) - F.log((n + 0.5) / (tn + 1.0))
        found.append(F.when((p >= least_texts) & (p * 4 >= n) & (odds >= least_odds), odds))
    scored = counted.select("entry", *(o.alias(f"o{k}") for k, o in enumerate(found)))
    rows = scored.where("coalesce(o0, o1, o2) is not null").collect()  # bounded by the sample
    return [{r.entry: float(r[f"o{k}"]) for r in rows if r[f"o{k}"] is not None} for k in range(3)]


class Trees:
    """Logistic gradient boosting over binned features."""

    def __init__(self, rounds: int = 50, depth: int = 3, rate: float = 0.2, bins: int = 48, least: float = 4.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.cuts: list[np.ndarray] = []
        self.start, self.trees = 0.0, []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)]) if self.cuts else np.zeros((len(x), 0), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.concatenate([np.quantile(c, np.linspace(0, 1, self.bins // 2)), np.quantile(c[c > c.min()], np.linspace(0, 1, self.bins // 2)) if (c > c.min()).any() else []])) for c in x.T]
        width = max((len(c) for c in self.cuts), default=0) + 1
        b = self._binned(x)
        rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.start = math.log(rate / (1 - rate))
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.full((1 << self.depth) - 1, -1), np.zeros((1 << self.depth) - 1, np.int64)
            for level in range(self.depth):
                nodes, base = 1 << level, (1 << level) - 1
                best = np.full(nodes, 1e-6)
                for k in range(x.shape[1]):
                    at = node * width + b[:, k]
                    gs = np.bincount(at, g, nodes * width).reshape(nodes, width).cumsum(axis=1)
                    hs = np.bincount(at, h, nodes * width).reshape(nodes, width).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hs < self.least / 4) | (ht - hs < self.least / 4)] = 0
                    top = gain.argmax(axis=1)
                    value = gain[np.arange(nodes), top]
                    better = value > best
                    best[better] = value[better]
                    feature[base : base + nodes][better] = k
                    cut[base : base + nodes][better] = top[better]
                own = base + node
                right = (feature[own] >= 0) & (b[np.arange(len(b)), np.maximum(feature[own], 0)] > cut[own])
                node = node * 2 + right
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge)
            margin += value[node]
            self.trees.append((feature, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self._binned(x), np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                own = (1 << level) - 1 + node
                node = node * 2 + ((feature[own] >= 0) & (b[rows, np.maximum(feature[own], 0)] > cut[own]))
            out += value[node]
        return out


class ToxicityModel:
    def __init__(self, lexicon: dict[str, float], trees: Trees | None, knots):
        self.lexicon, self.trees, self.knots = lexicon, trees, knots

    def probability(self, x: np.ndarray) -> np.ndarray:
        return calibrated(self.knots, self.trees.margin(x)) if self.trees else np.full(len(x), 0.5)


def fit(sample: DataFrame, folds: int = 4) -> ToxicityModel:
    """Fit on ``sample (doc_id, text, y)``, a bounded table; without rows the model answers 0.5."""
    ship(sample.sparkSession)
    halved = sample.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int"))
    *apart, lexicon = learn_lexicons(halved.select("text", "y", "half"))

    def work(batches):
        import pyarrow as pa

        of = [Features(apart[1]).of, Features(apart[0]).of]  # each half is seen through the other's lexicon
        for batch in batches:
            x = [of[h](t.as_py()) for t, h in zip(batch.column(1), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64())), batch.column(2)], ["doc_id", "x", "y"])

    rows = halved.select("doc_id", "text", F.col("y").cast("double"), "half").mapInArrow(work, "doc_id long, x array<double>, y double").collect()
    if not rows:
        return ToxicityModel(lexicon, None, (np.array([0.0]), np.array([0.5])))
    rows.sort(key=lambda r: r.doc_id)
    ids, x, y = np.array([r.doc_id for r in rows]), np.array([r.x for r in rows]), np.array([r.y for r in rows])
    fold, unseen = fold_of(ids, folds), np.zeros(len(y))
    for k in range(folds):
        if (fold == k).any() and (fold != k).any():
            unseen[fold == k] = Trees().fit(x[fold != k], y[fold != k]).margin(x[fold == k])
    return ToxicityModel(lexicon, Trees().fit(x, y), isotonic(unseen, y))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", threshold: float = 0.3, fit_rows: int = 20_000, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    ``score`` is the calibrated probability of label 1, from the text alone; null text scores as empty text does.
    Without labels every score is 0.5.  Repeated rows get equal scores.  ``fit_rows`` bounds the labelled rows that
    the model learns from.  Identifiers are whole numbers, or what a cast to long accepts; a row without one is scored
    and not learned from.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chosen = stage(labelled_sample(texts, labels, label, fit_rows), "chosen")
    sample = stage(texts.join(F.broadcast(chosen), "doc_id").repartition("doc_id").dropDuplicates(["doc_id"]), "sample")  # chosen: fit_rows narrow rows at most
    model = fit(sample, **options)

    def work(batches):
        import pyarrow as pa

        of = Features(model.lexicon).of
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = np.array([of(t.as_py()) for t in part.column(1)]).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.probability(x))], ["doc_id", "score"])

    scored = texts.mapInArrow(work, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
