"""Column functions over statement texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

FINGERPRINT = "class_id string, fingerprint string, kind string"


def classifier(most: int = 100_000):
    """A function from a statement to (class id, fingerprint, kind) that remembers the shapes of statements."""
    from ..sql.fingerprint import fingerprint, skeleton

    known: dict[str, tuple[str, str, str]] = {}

    def of(text: str | None) -> tuple[str, str, str]:
        key = skeleton(text or "")
        found = known.get(key)
        if found is None:
            fp = fingerprint(key)
            found = (fp.class_id, fp.text.encode("utf-8", "replace").decode(), fp.kind)
            if len(known) >= most:
                known.clear()
            known[key] = found
        return found

    return of


def with_fingerprints(events: DataFrame, column: str = "sql") -> DataFrame:
    """The frame with ``class_id, fingerprint, kind`` of a statement column; as it is if its source has added them.

    One Arrow pass; shapes of statements are remembered within a worker, since logs repeat themselves.
    """
    if {"class_id", "fingerprint", "kind"} <= set(events.columns):
        return events
    ship(events.sparkSession)
    held: list = []

    @F.pandas_udf(FINGERPRINT)
    def compute(texts):
        import pandas as pd

        if not held:
            held.append(classifier())
        return pd.DataFrame(list(map(held[0], texts)), columns=["class_id", "fingerprint", "kind"])

    compute.__annotations__ = {}
    return events.withColumn("_fp", compute(F.col(column))).select(*events.columns, "_fp.class_id", "_fp.fingerprint", "_fp.kind")


def fnv1a_64(text: Column) -> Column:
    """FNV-1a of a string's UTF-8 bytes as sixteen upper-case hex digits, in SQL functions alone.

    The 64-bit product is kept in two 32-bit halves, so that no step overflows a signed long.
    """
    hexed = F.hex(F.encode(text, "UTF-8"))
    bytes_ = F.when(F.length(hexed) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(hexed) - 1, F.lit(1)), F.lit(2)), lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast(T.ArrayType(T.LongType())))
    low_mask = F.lit(0xFFFFFFFF)

    def step(h, b):
        low = h["low"].bitwiseXOR(b)
        # times 2**40 + 0x1b3, modulo 2**64
        product = low * 0x1B3
        high = (h["high"] * 0x1B3 + F.shiftright(product, 32) + F.shiftleft(low.bitwiseAND(F.lit(0xFFFFFF)), 8)).bitwiseAND(low_mask)
        return F.struct(high.alias("high"), product.bitwiseAND(low_mask).alias("low"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("high"), F.lit(0x84222325).cast("long").alias("low"))
    done = F.aggregate(bytes_, start, step)
    return F.concat(F.lpad(F.hex(done["high"]), 8, "0"), F.lpad(F.hex(done["low"]), 8, "0"))
