"""Hashed maximum-entropy language model with a class-factored softmax.

    P(word | history) = P(class | history) * P(place | class, history) * (c(word) + 1) / Z(class, place)

* Counts c of all training tokens come from one distributed count.  The ``top`` most frequent words are broadcast
  (their number is the bound); all rarer and unknown words are resolved by a join on the word.
* A word's letters put it into one of ``CLUSTERS`` clusters (a mixture of letter-pair models, fitted to all broadcast
  words), its rank by frequency within the cluster into a tier: that is its class.  In all tiers but the last each
  word has a place of its own, and so have the first words of the last tier; its other broadcast words share places of
  equal mass, and the words beyond the broadcast share places by their last letters.  An unknown word has the mass of
  one count there.
* Both factors are softmaxes over hashed features, so context tells apart classes and the words of a class.  Features
  of the class: the previous word, the classes of the two previous words, and two skip features (the word before the
  previous one; the classes of the first and the third word back).  Features of the place, each together with the
  class: the previous word, the classes of the two previous words, the word before the previous one, and the two
  previous words' places.  The number of hashed rows grows with the vocabulary (``rows_for``) up to 2**18.
* Training: the runs are dealt over ``rounds`` slices.  In each round every task starts from the
  broadcast weights, takes gradient steps over its part of the slice in sparse batches, and returns its change in
  blocks of rows; Spark averages the blocks, and the driver holds one set of weights.
* Scoring: sparse numpy batches give log10 P(class, place | history); the words' own masses are added from the
  broadcast and from the join.

Texts are cut into tokens once: a staged table holds runs of documents as the list of their different words and the
tokens' places in it, so that counting, training and scoring look up each word once a run.  Tokens are worked on in
parts of a bounded number that know the ``HISTORY`` tokens before them.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from itertools import count, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.histogram import bucket_of
from .shared import ship, stage

CLUSTERS, TIERS, PLACES = 8, 4, 32  # rows of 32 weights fill whole cache lines
CLASSES = CLUSTERS * TIERS
SHARED, FAR = 4, 4  # places of a last tier that broadcast words share; that words beyond the broadcast share
OWN = PLACES - SHARED - FAR
END = b" "  # no word holds a blank
HISTORY = 3
BLOCK = 256
PAIRS = 1 << 12
STEP = 8192
SEGMENT = 1 << 20  # bytes of text
PART = 1 << 18  # tokens
TASK_TOKENS = 1 << 25
SHRINK, DECAY, STRIDE, LIMIT = 8.0, 3.0, 2.0, 8.0
NEVER = -60.0
NONE = np.uint64(0xFFFFFFFF)
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))


def segments_of(text: str | None, step: int = SEGMENT):
    """The tokens of a text, part by part: words between blanks (A-Z lower-cased), then one end."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    if len(raw) <= step:
        yield [*raw.split(), END]
        return
    at = 0
    while at < len(raw):
        cut = _BLANK.search(raw, at + step) if at + step < len(raw) else None
        end = cut.start() if cut else len(raw)
        yield raw[at:end].split()
        at = end
    yield [END]


def tokens_of(text: str | None) -> list[bytes]:
    """All tokens of a text."""
    return [w for words in segments_of(text) for w in words]


CODED = "ids array<long>, learn array<boolean>, sizes array<long>, words binary, codes binary"


class Run:
    """A run of whole documents: identifiers, which of them may be learned from, tokens of each, words and codes."""

    def __init__(self, ids, learn: np.ndarray, sizes: np.ndarray, words: list[bytes], codes: np.ndarray):
        self.ids, self.learn, self.sizes, self.words, self.codes = ids, learn, sizes, words, codes

    def tokens_to_learn(self) -> np.ndarray:
        return self.codes if self.learn.all() else self.codes[np.repeat(self.learn, self.sizes)]


def coded(docs: DataFrame) -> DataFrame:
    """``docs (doc_id, text, learn)`` as a staged table of runs; the first word of each run is the end."""
    schema = CODED

    def work(batches):
        import pyarrow as pa

        def fresh():
            index = defaultdict(count().__next__)
            index[END]  # noqa: B018  the end is word 0
            return index, [], [], [], [], 0

        def row(index, ids, learn, sizes, codes):
            flat = np.concatenate(codes)
            flat = flat.astype(np.uint16 if len(index) <= 1 << 16 else np.uint32)
            words = b" ".join(list(index)[1:])
            columns = ([ids], pa.list_(pa.int64())), ([learn], pa.list_(pa.bool_())), ([sizes], pa.list_(pa.int64())), ([words], pa.binary()), ([flat.tobytes()], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(*c) for c in columns], [x.split()[0] for x in schema.split(", ")])

        index, ids, learn, sizes, codes, size = fresh()
        for batch in batches:
            for doc, text, may in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text, n = text.as_py(), 0
                for words in segments_of(text):
                    codes.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
                    n += len(words)
                ids.append(doc)
                learn.append(may)
                sizes.append(n)
                size += len(text or "")
                if size >= SEGMENT:
                    yield row(index, ids, learn, sizes, codes)
                    index, ids, learn, sizes, codes, size = fresh()
        if ids:
            yield row(index, ids, learn, sizes, codes)

    return stage(docs.select("doc_id", "text", "learn").mapInArrow(work, schema), "coded", "zstd")


def runs_of(batches):
    """The runs in record batches of a coded table."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids, learn, sizes, words, codes = (batch.column(j)[k] for j in range(5))
            words = [END, *words.as_py().split()]
            codes = np.frombuffer(codes.as_buffer(), np.uint16 if len(words) <= 1 << 16 else np.uint32)
            yield Run(ids.values, learn.values.to_numpy(zero_copy_only=False).astype(bool), sizes.values.to_numpy(zero_copy_only=False), words, codes)


def counts_of(table: DataFrame, flush: int = 400_000) -> DataFrame:
    """``word, c`` over all tokens of a coded table that may be learned from."""

    def work(batches):
        import pyarrow as pa

        def emit(seen):
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        seen: dict[bytes, int] = {}
        for run in runs_of(batches):
            c = np.bincount(run.tokens_to_learn(), minlength=len(run.words)).tolist()
            for w, n in zip(run.words, c, strict=True):
                if n:
                    seen[w] = seen.get(w, 0) + n
            if len(seen) >= flush:
                yield emit(seen)
                seen = {}
        if seen:
            yield emit(seen)

    return table.mapInArrow(work, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequency_cut(counts: DataFrame, top: int) -> int:
    """The lowest frequency bucket such that at most ``top`` words lie in it and above.

    The histogram has a bounded number of buckets (exact below 64, 32 for each power of two beyond), so neither it nor
    the words above the cut grow with the corpus, and no task sends candidates that the driver would discard.
    """
    kept, cut = 0, 1 << 40
    for row in sorted(counts.groupBy(bucket_of(F.col("c")).alias("b")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.b):
        kept += row.n
        if kept > top:
            break
        cut = row.b
    return cut


def rows_for(kinds: int) -> int:
    """Hashed rows of each softmax for a vocabulary of ``kinds`` words: a power of two that grows as its square root."""
    return 1 << min(18, max(16, round(5 + math.log2(max(kinds, 1)) / 2)))


def _pairs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Letter pairs of framed words, as hashed numbers, and where each word begins."""
    raw = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begins = np.cumsum(sizes) - sizes
    pair = (raw[:-1] * 251 + raw[1:] * 17) % PAIRS
    inside = np.ones(len(raw), bool)
    inside[begins + sizes - 1] = False
    return pair[inside[:-1]], begins - np.arange(len(words))


def _by_bytes(words: list[bytes], limit: int = 1 << 20):
    """(first, words) of runs of a bounded number of bytes, one word at least."""
    at = size = 0
    for k, w in enumerate(words):
        size += len(w) + 2
        if size >= limit:
            yield at, words[at : k + 1]
            at, size = k + 1, 0
    if at < len(words):
        yield at, words[at:]


class Vocabulary:
    """The broadcast words with their counts, classes and places, and the mass of every class and place."""

    def __init__(self, words: list[bytes], counts: np.ndarray, seed: int = 7, turns: int = 12):
        self.index = {w: k for k, w in enumerate(words)}
        self.counts = counts
        self.letters = self._fit(words, counts, seed, turns)
        cluster = self.cluster(words)
        self.cls, self.place = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for k in range(CLUSTERS):
            own = np.flatnonzero(cluster == k)  # words come by falling frequency
            self.cls[own] = k * TIERS + np.minimum(np.arange(len(own)) // PLACES, TIERS - 1)
            self.place[own] = np.arange(len(own)) % PLACES
            last = own[(TIERS - 1) * PLACES :]
            self.place[last[:OWN]] = np.arange(len(last[:OWN]))
            upto = np.cumsum(counts[last[OWN:]] + 1.0)
            if len(upto):
                self.place[last[OWN:]] = OWN + np.minimum(upto / upto[-1] * SHARED, SHARED - 1).astype(np.int64)
        self.mass = np.zeros((CLASSES, PLACES))
        np.add.at(self.mass, (self.cls, self.place), counts + 1.0)
        self.mass[TIERS - 1 :: TIERS, -FAR:] += 1.0  # an unknown word

    @staticmethod
    def _fit(words: list[bytes], counts: np.ndarray, seed: int, turns: int) -> np.ndarray:
        """Log probabilities of letter pairs in each cluster, by expectation and maximisation over all words."""
        letters = np.zeros((PAIRS, CLUSTERS), np.float32)
        share = np.random.default_rng(seed).dirichlet(np.ones(CLUSTERS) * 0.5, len(words)).astype(np.float32)
        weight = np.log1p(counts).astype(np.float32)[:, None]
        runs = []
        for first, part in _by_bytes(words):
            pair, begins = _pairs(part)
            order = np.argsort(pair, kind="stable")
            own = pair[order]
            at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            owner = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(pair))))
            runs.append((slice(first, first + len(part)), pair.astype(np.int32), begins, owner[order].astype(np.int32), own[at], at))
        for _ in range(turns if words else 0):
            table = np.full((PAIRS, CLUSTERS), 0.02)
            held = share * weight
            for where, _, _, owner, own, at in runs:
                table[own] += np.add.reduceat(held[where][owner], at, axis=0)
            letters = np.log(table / table.sum(axis=0)).astype(np.float32)
            prior = np.log(held.sum(axis=0) / weight.sum() + 1e-6).astype(np.float32)
            for where, pair, begins, _, _, _ in runs:
                logs = np.add.reduceat(letters[pair], begins, axis=0) + prior
                logs = np.exp(logs - logs.max(axis=1, keepdims=True))
                share[where] = logs / logs.sum(axis=1, keepdims=True)
        return letters

    def cluster(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for first, part in _by_bytes(words):
            pair, begins = _pairs(part)
            out[first : first + len(part)] = np.add.reduceat(self.letters[pair], begins, axis=0).argmax(axis=1)
        return out

    def far(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Classes and places of words beyond the broadcast."""
        ends = np.fromiter((sum(w[-2:]) for w in words), np.int64, len(words))
        return self.cluster(words) * TIERS + TIERS - 1, PLACES - FAR + ends % FAR

    def biases(self) -> tuple[np.ndarray, np.ndarray]:
        """Log shares of the classes, and of the places within each class."""
        of_class = self.mass.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            first, second = np.log(of_class / of_class.sum()), np.log(self.mass / of_class[:, None])
        return tuple(np.where(np.isfinite(x), np.maximum(x, NEVER), NEVER).astype(np.float32) for x in (first, second))


class Numbered:
    """The different words of a run: numbers among the broadcast words or -1, names, classes and places."""

    def __init__(self, words: list[bytes], vocabulary: Vocabulary):
        from xxhash import xxh3_64_intdigest

        self.top = np.fromiter(map(vocabulary.index.get, words, repeat(-1)), np.int64, len(words))
        self.rare = np.flatnonzero(self.top < 0)
        far = [words[k] for k in self.rare]
        known, name = len(vocabulary.cls), self.top.astype(np.uint64)
        cls, place = (x[np.maximum(self.top, 0)] if known else np.zeros(len(words), np.int64) for x in (vocabulary.cls, vocabulary.place))
        if far:
            name[self.rare] = np.fromiter(map(xxh3_64_intdigest, far), np.uint64, len(far))
            cls[self.rare], place[self.rare] = vocabulary.far(far)
        self.name, self.cls, self.place = name, cls, place


class Batch:
    """Targets and feature rows of tokens ``[start, end)`` of a run."""

    def __init__(self, words: Numbered, run: Run, start: int, end: int, rows: int):
        first = max(0, start - HISTORY)
        codes = run.codes[first:end]
        ends = np.cumsum(run.sizes)
        doc = self._owners(ends, first, end)
        at = np.arange(first, end) - (ends - run.sizes)[doc]
        name, cls, place = words.name[codes], words.cls[codes], words.place[codes]

        def back(values, n, begin):
            out = np.empty_like(values)
            out[n:] = values[: max(0, len(values) - n)]
            out[:n] = begin
            out[at < n] = begin
            return out

        small, shift = cls.astype(np.uint64), np.uint64(64 - (rows.bit_length() - 1))
        leaf = small * np.uint64(PLACES) + place.astype(np.uint64)
        before, second = back(name, 1, NONE), back(name, 2, NONE)
        c1, c2, c3 = (back(small, n, CLASSES) for n in (1, 2, 3))
        classes, leaves = c1 * np.uint64(64) + c2, back(leaf, 1, CLASSES * PLACES) * np.uint64(1 << 16) + back(leaf, 2, CLASSES * PLACES)
        own = (small + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)
        kind = np.uint16 if rows <= 1 << 16 else np.uint32
        self.class_rows = [self._row(k, j, shift, kind)[start - first :] for j, k in enumerate((before, classes, second, c1 * np.uint64(64) + c3))]
        self.place_rows = [self._row(k ^ own, j + 4, shift, kind)[start - first :] for j, k in enumerate((before, classes, second, leaves))]
        self.doc, self.codes, self.cls, self.place = (x[start - first :] for x in (doc, codes, cls, place))

    @staticmethod
    def _owners(ends: np.ndarray, first: int, end: int) -> np.ndarray:
        """The document of each token in ``[first, end)``."""
        a, b = np.searchsorted(ends, [first, end - 1], "right")
        upto = np.minimum(ends[a : b + 1], end) - first
        return np.repeat(np.arange(a, b + 1), np.diff(upto, prepend=0))

    @staticmethod
    def _row(key: np.ndarray, j: int, shift, kind) -> np.ndarray:
        return ((key + np.uint64(j)) * _MIX[j % 4] >> shift).astype(kind)


def batches_of(run: Run, vocabulary: Vocabulary, rows: int):
    """(words, batch) for parts of a run."""
    words = Numbered(run.words, vocabulary)
    for start in range(0, len(run.codes), PART):
        yield words, Batch(words, run, start, min(start + PART, len(run.codes)), rows)


def softmax(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Probabilities of the sums of the hashed rows and the bias; weights are kept so small that nothing overflows."""
    z = np.empty((len(rows[0]), weights.shape[1]), np.float32)
    more = np.empty_like(z)
    np.take(weights, rows[0], 0, z, "clip")
    for r in rows[1:]:
        z += np.take(weights, r, 0, more, "clip")
    z += bias
    np.exp(z, out=z)
    z *= (1 / (z @ np.ones(z.shape[1], np.float32)))[:, None]
    return z


FEW = 8


def sums_by_row(grad: np.ndarray, order: np.ndarray, begins: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of ``grad`` over runs of ``order``: short runs element by element for all of them at once, long ones in one go."""
    total = np.take(grad, order[begins], 0, mode="clip")
    some = np.flatnonzero((n > 1) & (n <= FEW))
    for k in range(1, FEW):
        if not len(some):
            break
        total[some] += np.take(grad, order[begins[some] + k], 0, mode="clip")
        some = some[n[some] > k + 1]
    long = n > FEW
    if long.any():
        upto = np.cumsum(n[long])
        total[long] = np.add.reduceat(np.take(grad, order[np.repeat(long, n)], 0, mode="clip"), upto - n[long], axis=0)
    return total


def descend(weights: np.ndarray, bias: np.ndarray, visits: np.ndarray, rows: list[np.ndarray], target: np.ndarray, rate: float) -> None:
    """One gradient step on a sparse batch, in place.

    Each feature row moves by its mean residual times ``rate``, drawn toward zero for rows of few tokens (``SHRINK``),
    by ``STRIDE`` of it at most, and less with each visit (``DECAY``), so neither a frequent nor a rare feature
    overshoots, however few batches a task has.
    """
    grad = softmax(weights, bias, rows)
    grad[np.arange(len(target)), target] -= 1.0
    for r in rows:
        order = np.argsort(r, kind="stable")
        own = np.take(r, order)
        begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        at, n = own[begins].astype(np.int64), np.diff(np.r_[begins, len(own)])
        change = sums_by_row(grad, order, begins, n)
        change *= (np.minimum(rate / (n + SHRINK), STRIDE / n) / np.sqrt(1.0 + visits[at] / DECAY)).astype(np.float32)[:, None]
        np.subtract(np.take(weights, at, 0, mode="clip"), change, out=change)
        weights[at] = change
        visits[at] += 1


def train(table: DataFrame, vocabulary_sent, biases, rows: int, tasks: int, rounds: int, rate: float) -> list[np.ndarray]:
    """Weights of both softmaxes after ``rounds`` rounds, each over its slice of the runs, in at most ``tasks`` tasks."""
    spark = table.sparkSession
    widths = (CLASSES, PLACES)
    weights = [np.zeros((rows, w), np.float32) for w in widths]
    schema = "softmax int, block int, change binary, seen binary"
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(weights)

        def work(batches, sent=sent):
            import pyarrow as pa

            start, vocabulary = sent.value, vocabulary_sent.value
            own, visits = [w.copy() for w in start], [np.zeros(rows, np.float32) for _ in widths]
            for run in runs_of(batches):
                if not run.learn.any():
                    continue
                for _, batch in batches_of(Run(run.ids, run.learn, run.sizes[run.learn], run.words, run.tokens_to_learn()), vocabulary, rows):
                    for w in own:
                        np.clip(w, -LIMIT, LIMIT, out=w)
                    for at in range(0, len(batch.cls), STEP):
                        now = slice(at, at + STEP)
                        cls = batch.cls[now]
                        descend(own[0], biases[0], visits[0], [r[now] for r in batch.class_rows], cls, rate)
                        descend(own[1], biases[1][cls], visits[1], [r[now] for r in batch.place_rows], batch.place[now], rate)
            for k in range(len(widths)):
                for at in range(0, rows, 32 * BLOCK):
                    blocks = [b for b in range(at, min(at + 32 * BLOCK, rows), BLOCK) if visits[k][b : b + BLOCK].any()]
                    if blocks:
                        change = [(own[k][b : b + BLOCK] - start[k][b : b + BLOCK]).astype(np.float16).tobytes() for b in blocks]
                        seen = [(visits[k][b : b + BLOCK] > 0).tobytes() for b in blocks]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([k] * len(blocks), pa.int32()), pa.array(blocks, pa.int32()), pa.array(change, pa.binary()), pa.array(seen, pa.binary())],
                            ["softmax", "block", "change", "seen"],
                        )

        def merge(batches):
            import pyarrow as pa

            sums: dict[tuple[int, int], list] = {}
            for batch in batches:
                for k, block, change, seen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                    have = sums.setdefault((k, block), [np.zeros((BLOCK, widths[k]), np.float32), np.zeros(BLOCK, np.float32)])
                    have[0] += np.frombuffer(change.as_buffer(), np.float16).reshape(BLOCK, widths[k])
                    have[1] += np.frombuffer(seen.as_buffer(), np.bool_)
            if sums:
                mean = [(s / np.maximum(n, 1.0)[:, None]).astype(np.float16).tobytes() for s, n in sums.values()]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in zip(*sums, strict=True)), pa.array(mean, pa.binary())], ["softmax", "block", "mean"])

        part = table.where(F.pmod(F.xxhash64(F.get("ids", F.lit(0)), F.lit(17)), F.lit(rounds)) == turn)
        changes = part.coalesce(tasks).mapInArrow(work, schema)
        merged = changes.repartition(min(64, 2 * rows // BLOCK), "softmax", "block").mapInArrow(merge, "softmax int, block int, mean binary")
        for row in merged.collect():  # one set of weights: 2 * rows * 32 halves, 34 MB at most
            weights[row["softmax"]][row.block : row.block + BLOCK] += np.frombuffer(row["mean"], np.float16).reshape(BLOCK, -1)
        sent.unpersist()
    return weights


class LanguageModel:
    """A fitted model: the table of counts, the broadcast vocabulary and the weights."""

    def __init__(self, counts: DataFrame, total: int, kinds: int, vocabulary: Vocabulary, weights: list[np.ndarray]):
        self.counts, self.total, self.kinds = counts, total, kinds
        self.vocabulary, self.weights = vocabulary, weights


def held_out(doc_id):
    """True for rows that the model may not learn from: CRC-32 of the identifier's text, modulo 7, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def fit_lm(training: DataFrame, **options) -> LanguageModel:
    """Fit on all rows of ``training (doc_id, text)``; ``options`` are those of ``fit_coded``."""
    ship(training.sparkSession)
    return fit_coded(coded(training.select("doc_id", "text", F.lit(True).alias("learn"))), **options)


def fit_coded(table: DataFrame, top: int = 1 << 18, rounds: int = 2, rate: float = 6.0, rows: int | None = None) -> LanguageModel:
    """Fit on the documents of a coded table that may be learned from."""
    spark = table.sparkSession
    counts = stage(counts_of(table), "counts")
    total, kinds = (int(x or 0) for x in counts.agg(F.sum("c"), F.count("*")).first())
    cut = frequency_cut(counts, top)
    found = counts.where(bucket_of(F.col("c")) >= cut).select("word", "c").toArrow().to_pydict()  # ``top`` rows at most
    first = sorted(zip(found["c"], found["word"], strict=True), key=lambda r: (-r[0], r[1]))
    vocabulary = Vocabulary([w for _, w in first], np.array([c for c, _ in first], np.float64))
    sent = spark.sparkContext.broadcast(vocabulary)
    if len(first) < kinds:

        def masses(batches):
            import pyarrow as pa

            mass = np.zeros((CLASSES, PLACES))
            for batch in batches:
                np.add.at(mass, sent.value.far(batch.column(0).to_pylist()), batch.column(1).to_numpy(zero_copy_only=False) + 1.0)
            cls, place = np.nonzero(mass)
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(place, pa.int64()), pa.array(mass[cls, place])], ["cls", "place", "mass"])

        beyond = counts.where(bucket_of(F.col("c")) < cut).select("word", "c")
        for row in beyond.mapInArrow(masses, "cls long, place long, mass double").groupBy("cls", "place").agg(F.sum("mass").alias("mass")).collect():
            vocabulary.mass[row.cls, row.place] += row["mass"]
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-total // TASK_TOKENS))
    weights = train(table, sent, vocabulary.biases(), rows or rows_for(kinds), tasks, rounds, rate)
    return LanguageModel(counts, total, kinds, vocabulary, weights)


SCORED = "rid long, doc_id long, n_tokens long, n_known long, own double, mass double, rare array<struct<word:binary,n:long>>"


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: LanguageModel | None = None, **options) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Rows whose CRC-32 of the identifier's text, modulo 7, is 2 are held out of counts and training (a row without an
    identifier is not).  ``base_score`` is the add-one unigram model's log10 probability of the text, ``score`` the
    maximum-entropy model's.  Null text is empty and has the end alone.  Repeated rows count and are scored each.
    Identifiers are whole numbers, or what a cast to long accepts.  An empty table gives an empty result.  Other
    columns, whatever their names, are not read.  ``options`` are those of ``fit_coded``.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = held_out(F.col("doc_id"))
    table = coded(rows.withColumn("learn", ~held))
    model = model or fit_coded(table, **options)
    first, second = model.vocabulary.biases()
    sent = spark.sparkContext.broadcast((model.vocabulary, model.weights))

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        rid = TaskContext.get().partitionId() << 40
        vocabulary, weights = sent.value
        logs = np.log(vocabulary.counts + 1.0)
        with np.errstate(divide="ignore"):
            masses = np.log(vocabulary.mass)
        for run in runs_of(batches):
            n = len(run.sizes)
            known, own, amount, rare = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), []
            for words, batch in batches_of(run, vocabulary, len(weights[0])):
                chosen = -masses[batch.cls, batch.place]
                for at in range(0, len(chosen), STEP):
                    now = slice(at, at + STEP)
                    cls, place = batch.cls[now], batch.place[now]
                    every = np.arange(len(cls))
                    p = softmax(weights[0], first, [r[now] for r in batch.class_rows])[every, cls].astype(np.float64)
                    p *= softmax(weights[1], second[cls], [r[now] for r in batch.place_rows])[every, place]
                    chosen[now] += np.log(p)
                top = words.top[batch.codes]
                in_top = top >= 0
                known += np.bincount(batch.doc[in_top], minlength=n)
                own += np.bincount(batch.doc, chosen, n)
                amount += np.bincount(batch.doc[in_top], logs[top[in_top]], n)
                rare.append(batch.doc[~in_top] * len(run.words) + batch.codes[~in_top])
            pairs, times = np.unique(np.concatenate(rare), return_counts=True)
            doc, word = np.divmod(pairs, len(run.words))
            far = pa.StructArray.from_arrays([pa.array(run.words, pa.binary()).take(pa.array(word)), pa.array(times.astype(np.int64))], ["word", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), far)
            arrays = [pa.array(rid + np.arange(n)), run.ids, *(pa.array(x) for x in (run.sizes, known, own / math.log(10), amount / math.log(10))), lists]
            rid += n
            yield pa.RecordBatch.from_arrays(arrays, ["rid", "doc_id", "n_tokens", "n_known", "own", "mass", "rare"])

    scored = stage(table.mapInArrow(work, SCORED), "scored")
    c, n = F.col("c"), F.col("n")
    rare = scored.select("rid", F.explode("rare").alias("r")).select("rid", "r.word", "r.n")
    found = rare.join(model.counts, "word").groupBy("rid").agg(F.sum(n).alias("more"), F.sum(n * F.log10(c + 1.0)).alias("more_mass"))
    amount = F.col("mass") + F.coalesce("more_mass", F.lit(0.0))
    return scored.drop("rare").join(found, "rid", "left").select(
        "doc_id",
        held.alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (amount - F.col("n_tokens") * math.log10(model.total + model.kinds + 1)).alias("base_score"),
        (amount + F.col("own")).alias("score"),
    )
