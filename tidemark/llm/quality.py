"""Quality classifier: ridge regression on random Fourier features, with isotonic calibration.

1. Every whole text is reduced to a short vector of document statistics, in one pass that is written as a table.
2. Labelled rows (at most ``fit_rows``, a documented bound on the sample; the corpus itself is not sampled) are
   standardised and lifted to cosines of random projections, whose inner products approximate a Gaussian kernel.
3. Each partition sums its own normal equations for each fold; the driver adds a bounded number of such sums and
   solves them with a ridge.
4. Scores of rows by the model that has not seen their fold calibrate an isotonic map to probabilities.
5. All rows are scored from the table of statistics.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import calibrated, fold_of, held_out, isotonic, labelled_sample
from .shared import ROW, only_rows, ship, stage, with_rows

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_spread", "types_of_tokens", "top_word_share", "same_word_twice", "distinct_trigrams",
    "capital_share", "shouted_words", "digit_share", "stop_share", "exclamation_share", "symbol_share", "bar_share", "other_punctuation",
    "symbol_ended_words", "line_length", "repeated_lines", "space_share", "control_share", "byte_entropy", "non_ascii_share", "lone_letters",
)
_SYMBOL_END = re.compile(r"[*&%$#@^~=+<>!|\\]{2,}$")
_SYMBOLS = b"*&%$#@^~=+<>_\\{}[]`"


def statistics(text: str | None) -> list[float]:
    """The vector named by ``STATISTICS`` for one whole text; null counts as empty."""
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    seen = np.bincount(raw, minlength=256)
    total = max(1, len(raw))
    p = seen[seen > 0] / total
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = max(1, sum(seen[65:91]) + sum(seen[97:123]))
    trigrams = len(set(zip(words, words[1:], words[2:], strict=False)))
    return [
        math.log1p(len(text)),
        math.log1p(len(words)),
        float(lengths.mean()) if len(words) else 0.0,
        float(lengths.std()) if len(words) else 0.0,
        math.log1p(len(counts)) / math.log1p(n),
        max(counts.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n,
        trigrams / max(1, len(words) - 2),
        seen[65:91].sum() / letters,
        sum(x.isupper() and len(x) > 2 for x in counts.elements()) / n,
        seen[48:58].sum() / total,
        seen[46] / n,
        seen[33] / n,
        sum(seen[c] for c in _SYMBOLS) / n,
        seen[124] / n,
        sum(seen[c] for c in b",;:?'\"()-/") / n,
        sum(k for w, k in counts.items() if _SYMBOL_END.search(w)) / n,
        math.log1p(chars / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
        (seen[32] + seen[10] + seen[9]) / total,
        (seen[:9].sum() + seen[14:32].sum()) / total,
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
        seen[128:].sum() / total,
        sum(k for w, k in counts.items() if len(w) == 1) / n,
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, x`` and the long columns ``carried`` for every row, in the shared folder."""
    ship(docs.sparkSession)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([statistics(t.as_py()) for t in part.column(1)], pa.list_(pa.float64())), *part.columns[2:]], ["doc_id", "x", *carried])

    return stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carried).mapInArrow(work, ", ".join(["doc_id long, x array<double>", *(f"`{c}` long" for c in carried)])), "statistics")


class FourierRidge:
    """Standardisation, random Fourier features, weights and calibration."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.plane = rng.standard_normal((len(mean), features)) / (width * math.sqrt(len(mean)))
        self.phase = rng.uniform(0, 2 * math.pi, features)
        self.weights = np.zeros(features + 1)
        self.knots = (np.array([0.0]), np.array([0.5]))

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.cos(z @ self.plane + self.phase) * math.sqrt(2 / len(self.phase)), np.ones((len(x), 1))])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return calibrated(self.knots, self.lift(x) @ self.weights)


def fit(sample: DataFrame, features: int = 384, width: float = 1.0, ridge: float = 1e-3, folds: int = 4, sums: int = 8, seed: int = 5) -> FourierRidge:
    """Fit on ``sample (doc_id, x, y)``; without rows the model answers 0.5."""
    dims = len(STATISTICS)
    parts = stage(sample.select("doc_id", "x", F.col("y").cast("double").alias("y")).repartition(sums, "doc_id"), "sample")
    moments = parts.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("k").collect()
    if not moments:
        return FourierRidge(np.zeros(dims), np.ones(dims), features, width, seed)
    model = FourierRidge(np.array([r.m for r in moments]), np.array([r.s for r in moments]), features, width, seed)
    size = features + 1

    def arrays(batch):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        return ids, x, batch.column(2).to_numpy(zero_copy_only=False)

    def add_up(batches):
        import pyarrow as pa

        total = np.zeros((folds, size, size + 1))
        for batch in batches:
            ids, x, y = arrays(batch)
            z, fold = model.lift(x), fold_of(ids, folds)
            for k in range(folds):
                own = z[fold == k]
                total[k] += own.T @ np.column_stack([own, y[fold == k]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    total = np.zeros((folds, size, size + 1))
    for row in parts.coalesce(sums).mapInArrow(add_up, "total binary").toLocalIterator():
        total += np.frombuffer(row.total).reshape(total.shape)

    def solve(equations):
        return np.linalg.solve(equations[:, :size] + ridge * max(1.0, equations[-1, size - 1]) / features * np.eye(size), equations[:, size])

    apart = [solve(total.sum(axis=0) - total[k]) for k in range(folds)]

    def unseen(batches):
        import pyarrow as pa

        for batch in batches:
            ids, x, y = arrays(batch)
            s = (model.lift(x) * np.array(apart)[fold_of(ids, folds)]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(y)], ["s", "y"])

    checked = np.array(parts.mapInArrow(unseen, "s double, y double").collect(), float).reshape(-1, 2)
    model.weights, model.knots = solve(total.sum(axis=0)), isotonic(checked[:, 0], checked[:, 1])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", threshold: float = 0.7, fit_rows: int = 60_000, carried: tuple[str, ...] = (), **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the long columns ``carried`` for every row of ``docs``.

    ``score`` is the calibrated probability of label 1, from the text alone; null text scores as empty text does.
    Without labels every score is 0.5.  Repeated rows get equal scores.  ``fit_rows`` bounds the labelled rows that
    the model learns from.  Identifiers are whole numbers, or what a cast to long accepts; a row without one is scored
    and not learned from.
    """
    table = document_statistics(docs, id_col, text_col, carried)
    chosen = labelled_sample(table, labels, label, fit_rows)
    model = fit(table.dropDuplicates(["doc_id"]).join(chosen, "doc_id"), **options)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.probability(x)), *batch.columns[2:]], ["doc_id", "score", *carried])

    scored = table.mapInArrow(work, ", ".join(["doc_id long, score double", *(f"`{c}` long" for c in carried)]))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *carried)


def drop_poor(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns.

    Each row is judged by its own text, also where identifiers are null or repeated.
    """
    keyed = with_rows(docs)
    poor = quality_scores(keyed, labels, id_col, text_col, carried=ROW, **options).where("predicted = 0")
    return only_rows(keyed, poor, docs.columns, "left_anti")
