"""Exact deduplication by a tree merge of sorted digest runs (DataFrame functions only).

Every row is reduced to (digest, place of the row, length).  Rows are dealt over ``leaves`` by a hash of the row's place,
so a text that holds a third of the corpus is spread evenly, and each leaf is collapsed to one row per digest, partly
before the exchange already.  From there on a run is one partition, sorted by digest:

* The digests' first bits cut the digest space into ``lanes``, and each lane has a merge tree of its own over ``runs``
  runs, so that the root of a tree is not one task for the whole corpus.
* In each round a partition sends its whole run to the partition of run ``run / fan_in`` of its lane.  There the
  ``fan_in`` runs are brought into one order and one streaming pass merges them (a sort aggregation without another
  exchange): only the best verified row and the summed count of a digest go on.

A round moves at most one row for each digest and run, whatever the size of a group of copies.  The way down reverses
the tree: the roots' winners go to the leaves (at most ``leaves`` rows for a digest), and the rows look up their own
leaf's row, so no task ever gathers all copies of a text.

Verification: rows merge only if the whole 256-bit digest and the byte length of the normalised text agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ROW, only_rows, shuffle_width, stage, with_rows

#: Characters that do not count in a comparison: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
RUNS, FAN_IN = 16, 4


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def _merge(level: DataFrame, *by: str) -> DataFrame:
    return level.groupBy(*by, "digest", "width").agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def _round(level: DataFrame, run: Column, lanes: int, runs: int) -> DataFrame:
    """One round: rows move to the partition of ``run`` in their lane, a whole run to one place, and are merged there."""
    moved = level.withColumn("run", run.cast("int")).withColumn("unit", F.col("lane") * runs + F.col("run"))
    together = moved.repartitionById(lanes * runs, F.col("unit")).sortWithinPartitions("unit", "lane", "run", "digest", "width")
    return _merge(together, "unit", "lane", "run").drop("unit")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal normalised texts exactly one row stays: the one with the most code points in its original text, then the
    smallest identifier; null identifiers lose to all others, and of rows that agree in both the first by file and place
    stays, so that repeated rows are dropped as well.  All rows count in ``group_size``.  Null text is empty text.
    Identifiers may have any type that can be ordered.  An empty table gives an empty result.  Other columns, whatever
    their names, are not read.  ``options`` are those of ``grouped_rows``.
    """
    return grouped_rows(with_rows(docs), id_col, text_col, **options).drop(*ROW)


def grouped_rows(rows: DataFrame, id_col: str, text_col: str, leaves: int | None = None, lanes: int | None = None, runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """``exact_groups`` of rows that have their ``ROW`` columns, with these columns."""
    width = shuffle_width(rows.sparkSession)
    leaves = leaves or 1 << max(2, (width - 1).bit_length())
    lanes = lanes or max(4, 1 << (max(1, width // RUNS) - 1).bit_length())
    if lanes & (lanes - 1) or runs < 1 or fan_in < 2:
        raise ValueError("lanes must be a power of two, runs at least 1 and fan_in at least 2")
    text = F.col("text")
    digests = stage(
        rows.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *ROW)
        .select("doc_id", F.length(text).cast("long").alias("chars"), normalised(text).alias("norm"), *ROW)
        .select(
            "doc_id",
            "chars",
            F.octet_length("norm").cast("long").alias("width"),
            F.unhex(F.sha2("norm", 256)).alias("digest"),
            F.pmod(F.xxhash64(*ROW), F.lit(leaves)).cast("int").alias("leaf"),
            *ROW,
        ),
        "digests",
    )
    best = F.struct((-F.col("chars")).alias("shorter"), F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), *ROW)
    leaf = _merge(digests.select("leaf", "digest", "width", best.alias("best"), F.lit(1).cast("long").alias("n")), "leaf")
    lane = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % lanes
    level = _round(leaf.withColumn("lane", lane.cast("int")), F.pmod(F.col("leaf"), F.lit(runs)), lanes, runs)
    left = runs
    while left > 1:
        left = -(-left // fan_in)
        level = _round(level, F.floor(F.col("run") / fan_in), lanes, left)
    winners = level.select("digest", "width", F.col("best").alias("winner"), F.col("n").alias("group_size"))
    of_leaf = leaf.select("leaf", "digest", "width").join(winners, ["digest", "width"])
    return digests.join(of_leaf, ["leaf", "digest", "width"]).select(
        "doc_id",
        F.col("winner.id").alias("keep_id"),
        "group_size",
        ((F.col(ROW[0]) == F.col(f"winner.{ROW[0]}")) & (F.col(ROW[1]) == F.col(f"winner.{ROW[1]}"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *ROW,
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay, one of each text, with all their columns; see ``exact_groups``.

    Rows are told apart by their place, so null and repeated identifiers and repeated rows do not keep a copy in.
    """
    keyed = with_rows(docs)
    return only_rows(keyed, grouped_rows(keyed, id_col, text_col, **options).where("kept"), docs.columns)
