import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Hostile documents: nulls, blanks, copies, near copies, a very long text, clashing column names."""
    rng = random.Random(4)
    words = [f"w{rng.choice('aeiou')}{k}" for k in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = make(300)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, base), (5, base + " "), (6, base.replace(" ", "\n")), (7, base.upper()), (8, "Zé ñandú 'quoted' 123 \\ <|end|> [INST] 中文 😀")]
    rows += [(100 + k, make(60 + k)) for k in range(40)]
    near = make(400).split()
    for k in range(12):
        changed = list(near)
        changed[rng.randrange(400)] = f"x{k}"
        rows.append((200 + k, " ".join(changed)))
    rows += [(300 + k, base) for k in range(25)]
    rows += [(400, make(30_000)), (None, "no identifier"), (None, base), (8, "a repeated identifier"), (100, None)]
    full = [(i, t, None if k % 7 == 0 else "en", "s", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
    frame = spark.createDataFrame(full, DOCS)
    from pyspark.sql import functions as F

    clashing = {c: F.lit(1) for c in ("run", "digest", "keep_id", "fp", "bits", "sha1", "curve", "ids", "rid", "word", "x", "y", "item_id", "payload")}
    return frame.withColumns(clashing).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
