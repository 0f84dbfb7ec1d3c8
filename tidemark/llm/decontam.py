"""Benchmark decontamination with suffix arrays over shards of the training documents.

Documents are read in shards of a bounded number of bytes.  A shard's words become integers (the benchmark's
vocabulary; any other word can match nothing), and its suffixes are sorted in full: as far as the longest test suffix
reaches, up to their end at a word that no test has.  The array is sparse: it leaves out suffixes whose first two words
begin no test window, since they cannot match for the length of a window.  Beside it stands the array of common
prefixes of neighbours.

Every test suffix is located by binary search, all of them at once: the range of suffixes that share its window first,
then its place within that range.  The longest verbatim match is the longer common prefix with the two neighbours of
that place, and the matches with all others in the range follow from the array of common prefixes.  Matches that could
begin a word earlier belong to an earlier test suffix and are left out.

A window is ``window`` consecutive words of an item, or the whole of a shorter item.  The benchmark lies in files of
the shared folder, in blocks of at most ``block_bytes`` of text; a worker holds the index of one block at a time.
Shards need no exchange of documents at all.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ROW, new_folder, only_rows, open_filesystem, ship, with_rows

#: Bytes of words: digits, small letters, and everything beyond ASCII; capitals become small, the rest separates words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SEPARATOR, UNKNOWN = -1, -2
STRETCH = 32  # words that a comparison looks at at a time


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8: runs of digits, letters (A-Z lower-cased) and characters beyond ASCII; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def common_prefix(a: np.ndarray, at: np.ndarray, b: np.ndarray, own: np.ndarray, most: int) -> np.ndarray:
    """For each pair the number of equal words, ``most`` at most, of ``a[at:]`` and ``b[own:]``; a word below 0 equals nothing."""
    length = np.zeros(len(at), np.int64)
    going, steps = np.arange(len(at)), np.arange(STRETCH)
    while len(going):
        x = a[np.minimum((at[going] + length[going])[:, None] + steps, len(a) - 1)]
        y = b[np.minimum((own[going] + length[going])[:, None] + steps, len(b) - 1)]
        differ = (x != y) | (x < 0)
        some = differ.any(axis=1)
        length[going] += np.where(some, differ.argmax(axis=1), STRETCH)
        going = going[~some & (length[going] < most)]
    return np.minimum(length, most)


class WindowIndex:
    """The test suffixes and windows of a block of items."""

    def __init__(self, items: list[tuple[int, str]], window: int = 8):
        by_text: dict[tuple[bytes, ...], list[int]] = {}
        for item, text in items:
            if item is not None and (words := tuple(words_of(text))):
                by_text.setdefault(words, []).append(item)
        texts = sorted(by_text)
        self.longest = max(map(len, texts), default=0)
        self.width, self.ids = window, [sorted(set(by_text[t])) for t in texts]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
        coded = [np.array([self.vocabulary[w] for w in t], np.int64) for t in texts]
        self.begin = np.cumsum([1, *(len(c) + window for c in coded)])[:-1]
        flat = [np.full(1, SEPARATOR - 10, np.int64)]
        for c in coded:
            flat += [c, np.full(window, SEPARATOR - 10, np.int64)]
        self.words = np.concatenate(flat)
        item_of, at, size = [], [], []
        for k, c in enumerate(coded):
            n = max(1, len(c) - window + 1)
            item_of.append(np.full(n, k))
            at.append(np.arange(n))
            size.append(np.full(n, min(window, len(c))))
        empty = np.zeros(0, np.int64)
        self.item_of, self.at, size = (np.concatenate(x) if x else empty for x in (item_of, at, size))
        rows = self.words[(self.begin[self.item_of] + self.at)[:, None] + np.arange(window)] if len(size) else np.zeros((0, window), np.int64)
        rows = np.where(np.arange(window) < size[:, None], rows, SEPARATOR - 10)
        self.rows, inverse = np.unique(rows, axis=0, return_inverse=True)
        inverse = inverse.reshape(-1)
        self.sizes = (self.rows >= 0).sum(axis=1)
        self.places = np.argsort(inverse, kind="stable")  # occurrences in items, by window
        self.place_from = np.searchsorted(inverse[self.places], np.arange(len(self.rows) + 1))
        n = len(self.vocabulary)
        self.first = np.zeros(n + 1, bool)
        self.alone = np.zeros(n + 1, bool)
        self.first[self.rows[:, 0]] = True
        self.alone[self.rows[self.sizes == 1, 0]] = True
        two = self.rows[self.sizes > 1]
        self.pairs = np.unique(two[:, 0] * (n + 1) + two[:, 1])

    def code(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, UNKNOWN) for w in words), np.int64, len(words))

    def suffixes(self, shard: np.ndarray) -> np.ndarray:
        """Sparse suffix array of a coded shard (which ends in ``width`` separators)."""
        n = len(self.vocabulary)
        at = np.flatnonzero(self.first[np.where(shard[: len(shard) - self.width] < 0, n, shard[: len(shard) - self.width])])
        pair = shard[at] * (n + 1) + np.maximum(shard[at + 1], 0)
        known = np.searchsorted(self.pairs, pair)
        fits = (shard[at + 1] >= 0) & (self.pairs[np.minimum(known, len(self.pairs) - 1)] == pair) if len(self.pairs) else np.zeros(len(at), bool)
        return self._sorted(shard, at[fits | self.alone[shard[at]]])

    def _sorted(self, shard: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Suffixes in the order of their words; those that agree as far as a test can reach, or to their end, by place."""
        tied, group, depth = np.arange(len(order)), np.zeros(len(order), np.int64), 0
        while len(tied) and depth < self.longest:
            step = self.width if depth == 0 else STRETCH
            words = shard[np.minimum((order[tied] + depth)[:, None] + np.arange(step), len(shard) - 1)]
            words[np.logical_or.accumulate(words < 0, axis=1)] = SEPARATOR  # a suffix ends there
            by = np.lexsort([*words.T[::-1], group])
            order[tied], words, group = order[tied][by], words[by], group[by]
            same = (group[1:] == group[:-1]) & (words[1:] == words[:-1]).all(axis=1) & (words[1:, -1] >= 0)
            near = np.r_[same, False] | np.r_[False, same]
            group = np.cumsum(np.r_[True, ~same])[near]
            tied, depth = tied[near], depth + step
        return order

    def _bound(self, shard: np.ndarray, order: np.ndarray, after: bool) -> np.ndarray:
        """For each window the first place in ``order`` that is not before it (or that is after all it begins)."""
        low, high = np.zeros(len(self.rows), np.int64), np.full(len(self.rows), len(order))
        steps = np.arange(self.width)
        counts = steps < self.sizes[:, None]
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            have, want = shard[order[mid][:, None] + steps], self.rows[open_]
            differ = (have != want) & counts[open_]
            where = differ.argmax(axis=1)
            some = differ[np.arange(len(where)), where]
            less = np.where(some, have[np.arange(len(where)), where] < want[np.arange(len(where)), where], after)
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
        return low

    def search(self, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The suffix array, and the range in it of every window."""
        order = self.suffixes(shard)
        return order, self._bound(shard, order, False), self._bound(shard, order, True)

    @staticmethod
    def spread(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(k, values[j]) for every range k and every j in [a[k], b[k])."""
        own = np.repeat(np.arange(len(a)), b - a)
        return own, values[np.arange(len(own)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)]

    def matches(self, shard: np.ndarray, order: np.ndarray, a: np.ndarray, b: np.ndarray):
        """Matches (position, item, place in the item, words) of test suffixes that cannot begin a word earlier."""
        window, place = self.spread(self.places, self.place_from[:-1][a < b], self.place_from[1:][a < b])
        window = np.flatnonzero(a < b)[window]
        a, b, size = a[window], b[window], self.sizes[window]
        item, j = self.item_of[place], self.at[place]
        own, whole = self.begin[item] + j, size < self.width  # a short item is its own window
        low, high = a.copy(), b.copy()
        while (open_ := np.flatnonzero((low < high) & ~whole)).size:  # the place of the whole test suffix
            mid = (low[open_] + high[open_]) // 2
            at, test = order[mid], own[open_]
            n = common_prefix(shard, at, self.words, test, self.longest)
            have, want = shard[np.minimum(at + n, len(shard) - 1)], self.words[np.minimum(test + n, len(self.words) - 1)]
            less = np.maximum(have, SEPARATOR) < np.maximum(want, SEPARATOR)
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
        beside = [common_prefix(shard, order[np.clip(low + k, a, np.maximum(a, b - 1))], self.words, own, self.longest) for k in (-1, 0)]
        shared = common_prefix(shard, order[:-1], shard, order[1:], self.longest)
        found = []
        for k in range(len(a)):
            first, last, here = int(a[k]), int(b[k]), int(low[k])
            if whole[k]:
                n = np.full(last - first, size[k])
            else:
                after = np.minimum.accumulate(np.r_[beside[1][k], shared[here : last - 1]]) if here < last else shared[:0]
                before = np.minimum.accumulate(np.r_[beside[0][k], shared[first : here - 1][::-1]])[::-1] if here > first else shared[:0]
                n = np.r_[before, after]
            at = order[first:last]
            if not whole[k]:
                begins = (at == 0) | (shard[np.maximum(at - 1, 0)] != self.words[own[k] - 1])
                at, n = at[begins], n[begins]
            found.append((at, np.full(len(at), item[k]), np.full(len(at), j[k]), n))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4


def scan_shard(words: list[list[bytes]], indexes) -> list[tuple[int, int, list[int], list[tuple[int, int, int, int]]]]:
    """For each document (n_words, n_hit, item ids, matches (start, item id, place in the item, words))."""
    sizes = np.array([len(w) for w in words], np.int64)
    out_items: list[set[int]] = [set() for _ in words]
    out_matches: list[list] = [[] for _ in words]
    hit = None
    for index in indexes:
        gap = index.width
        begin = np.concatenate([[0], np.cumsum(sizes + gap)])
        shard = np.full(int(begin[-1]) + gap, SEPARATOR, np.int64)
        for k, w in enumerate(words):
            shard[begin[k] : begin[k] + len(w)] = index.code(w)
        if hit is None:
            hit = np.zeros(len(shard) + 1, np.int64)
        if not len(index.rows):
            continue
        order, low, high = index.search(shard)
        window, at = index.spread(order, low, high)
        if not len(at):
            continue
        np.add.at(hit, at, 1)
        np.add.at(hit, at + index.sizes[window], -1)
        doc = np.searchsorted(begin, at, "right") - 1
        n = len(index.rows)
        for code in np.unique(doc * n + window):
            k, w = divmod(int(code), n)
            for place in index.places[index.place_from[w] : index.place_from[w + 1]]:
                out_items[k].update(index.ids[index.item_of[place]])
        for p, item, j, size in zip(*(x.tolist() for x in index.matches(shard, order, low, high)), strict=True):
            k = int(np.searchsorted(begin, p, "right") - 1)
            out_matches[k] += [(p - int(begin[k]), name, j, size) for name in index.ids[item]]
    if hit is None:
        return [(int(s), 0, [], []) for s in sizes]
    covered = np.concatenate([[0], np.cumsum(np.cumsum(hit) > 0)])
    return [(int(s), int(covered[b + s] - covered[b]), sorted(i), sorted(m)) for s, b, i, m in zip(sizes, begin, out_items, out_matches, strict=False)]


FOUND = "doc_id long, n_words long, n_hit long, items array<long>, matches array<struct<start:long,item_id:long,item_start:long,words:long>>"
_held: dict[str, WindowIndex] = {}


def _block(path: str, window: int) -> WindowIndex:
    """The index of a block of items; a worker remembers the last one."""
    key = f"{window} {path}"
    if key not in _held:
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSelector

        _held.clear()
        fs, base = open_filesystem(path)
        items: list[tuple[int, str]] = []
        for file in sorted(f.path for f in fs.get_file_info(FileSelector(base, allow_not_found=True)) if f.path.endswith(".parquet")):
            with fs.open_input_file(file) as source:
                table = pq.ParquetFile(source).read()
            items += zip(table.column("item").to_pylist(), table.column("text").to_pylist(), strict=True)
        _held[key] = WindowIndex(items, window)
    return _held[key]


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 8,
    shard_bytes: int = 1 << 24,
    block_bytes: int = 1 << 24,
    carried: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, n_words, n_hit, items, matches`` and the long columns ``carried`` for each row of ``docs``.

    ``items`` are the identifiers of the items with an occurring window; ``n_hit`` counts the words inside any
    occurrence; ``matches`` are the longest verbatim matches of test suffixes that cannot begin a word earlier.  Null or
    wordless text has no words; items without words or without an identifier have no window.  Repeated rows of either
    table change nothing but the rows returned.  Identifiers are whole numbers, or what a cast to long accepts.
    """
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).where("item is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    folder = new_folder(spark, "benchmark")
    items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))).repartition(min(blocks, 200), "block").write.partitionBy("block").parquet(folder)

    def work(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("start", pa.int64()), ("item_id", pa.int64()), ("item_start", pa.int64()), ("words", pa.int64())]))]
        names = ["doc_id", "n_words", "n_hit", "items", "matches", *carried]

        def flush(ids, words, more):
            found = scan_shard(words, (_block(f"{folder}/block={k}", window) for k in range(blocks)))
            rows = [(i, *f[:3], [dict(zip(("start", "item_id", "item_start", "words"), m, strict=True)) for m in f[3]]) for i, f in zip(ids, found, strict=True)]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in zip(*more, strict=True))], names)

        ids, words, more, size = [], [], [], 0
        for batch in batches:
            rest = zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True) if carried else ((),) * batch.num_rows
            for doc, text, extra in zip(batch.column(0).to_pylist(), batch.column(1), rest, strict=True):
                ids.append(doc)
                more.append(extra)
                text = text.as_py()
                words.append(words_of(text))
                size += len(text or "") + 64
                if size >= shard_bytes:
                    yield flush(ids, words, more)
                    ids, words, more, size = [], [], [], 0
        if ids:
            yield flush(ids, words, more)

    schema = ", ".join([FOUND, *(f"`{c}` long" for c in carried)])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carried).mapInArrow(work, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, carried: tuple[str, ...] = (), **options) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match`` and ``carried`` per document; see ``find_matches``."""
    found = find_matches(docs, benchmark, carried=carried, **options)
    names = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (F.size("items") >= min_items).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["words"])), F.lit(0)).alias("longest_match"),
        *carried,
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", min_items: int = 2, text_col: str = "text", **options) -> DataFrame:
    """The documents with fewer than ``min_items`` items in them, with all their columns.

    Each row is judged by its own text, also where identifiers are null or repeated.
    """
    keyed = with_rows(docs)
    bad = contamination(keyed, benchmark, min_items, carried=ROW, id_col=id_col, text_col=text_col, **options).where("contaminated")
    return only_rows(keyed, bad, docs.columns, "left_anti")


def items_digest(items: list[int]) -> str:
    """SHA-256 of the identifiers sorted as strings and joined by commas."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
