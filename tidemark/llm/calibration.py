"""Isotonic calibration and the split of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stage


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from: CRC-32 of the identifier's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, y``: the labels that may be learned from, all of them or a sample of about ``rows`` and not more.

    The sample keeps the identifiers whose hash lies below a threshold, which aims a little under ``rows`` so that
    chance does not exceed it; no task sends candidates to the driver.  An identifier with several labels counts with
    the largest; null labels and identifiers are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    present = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    usable = stage(known.where(~held_out(F.col("doc_id"))).join(present, "doc_id", "left_semi"), "labelled")
    count = usable.count()
    if count <= rows:
        return usable
    share = max(0.0, rows - 4 * rows**0.5) / count
    return usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit: knots (score, probability), both ascending.

    Each block of the fit has a knot at its two ends, so that values between blocks are interpolated.  Block means
    are drawn a little toward the base rate, which keeps blocks of a few rows from claiming certainty.
    """
    if not len(scores):
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(scores, kind="stable")
    base = float(labels.mean())
    blocks: list[list[float]] = []  # total, weight, first score, last score
    for s, y in zip(scores[order].tolist(), labels[order].tolist(), strict=True):
        if blocks and blocks[-1][3] == s:
            blocks[-1][0] += y
            blocks[-1][1] += 1
        else:
            blocks.append([y, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, w, _, last = blocks.pop()
            blocks[-1][0] += t
            blocks[-1][1] += w
            blocks[-1][3] = last
    x = np.array([e for b in blocks for e in (b[2], b[3])])
    p = np.repeat([(b[0] + 0.5 * base) / (b[1] + 0.5) for b in blocks], 2)
    return x, np.maximum.accumulate(p)


def calibrated(knots: tuple[np.ndarray, np.ndarray], scores: np.ndarray) -> np.ndarray:
    return np.clip(np.interp(scores, *knots), 0.0, 1.0)


def fold_of(doc_ids: np.ndarray, folds: int) -> np.ndarray:
    """A fold number that depends on the identifier alone."""
    mixed = (doc_ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return (mixed % np.uint64(folds)).astype(np.int64)
