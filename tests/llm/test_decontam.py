import random
import re

import pytest

from tidemark.llm.decontam import contamination, drop_contaminated, find_matches, items_digest

BENCH = "item_id long, text string"


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, window=8):
    out = []
    for doc, text in docs:
        own = words(text)
        hit, found, longest = set(), set(), 0
        for item, item_text in items:
            test = words(item_text)
            if item is None or not test:
                continue
            size = min(window, len(test))
            grams = {tuple(test[k : k + size]) for k in range(len(test) - size + 1)}
            for at in range(len(own) - size + 1):
                if tuple(own[at : at + size]) in grams:
                    hit.update(range(at, at + size))
                    found.add(item)
                    for j in range(len(test) - size + 1):
                        n = 0
                        while at + n < len(own) and j + n < len(test) and own[at + n] == test[j + n]:
                            n += 1
                        if n >= size:
                            longest = max(longest, n if len(test) >= window else size)
        out.append((doc, len(own), len(hit), len(found), items_digest(list(found)), len(found) >= 2, longest))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(9)
    vocabulary = [f"v{k}" for k in range(30)] + ["é", "Zo", "中文"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, make(rng.choice([9, 12, 25, 60]))) for k in range(30)] + [(100, "v1 v2"), (101, "V1, v2!"), (102, ""), (103, None), (104, "..."), (105, "v3 " * 12), (None, make(12)), (106, "unique")]
    items.append((5, items[6][1]))
    docs = []
    for k in range(60):
        parts = [make(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            test = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(test) - 8))
            parts += [" ".join(test[a : a + rng.randint(5, 40)]).upper(), make(rng.randint(0, 5))]
        docs.append((k, " \n".join(parts)))
    docs += [(200, None), (201, ""), (202, "v3 " * 500), (203, "v1 v2"), (203, "v1 v2"), (None, "V1 V2 unique"), (204, make(20_000))]
    return docs, items


@pytest.mark.parametrize("shard_bytes", [1 << 24, 500])
@pytest.mark.parametrize("block_bytes", [1 << 24, 300])
def test_contamination(spark, case, shard_bytes, block_bytes):
    docs, items = case
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, BENCH), shard_bytes=shard_bytes, block_bytes=block_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_matches_are_verbatim(spark, case):
    docs, items = case
    named = {i: words(t) for i, t in docs}
    tests = {}
    for i, t in items:
        tests.setdefault(i, []).append(words(t))
    for r in find_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, BENCH)).collect():
        for m in r.matches:
            piece = named[r.doc_id][m.start : m.start + m.words]
            assert any(t[m.item_start : m.item_start + m.words] == piece for t in tests[m.item_id])


def test_filter_and_empty_tables(spark, docs, empty):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, "no identifier")], BENCH)
    none = spark.createDataFrame([], BENCH)
    assert contamination(empty, bench).count() == 0
    assert contamination(docs, none).where("n_items > 0").count() == 0
    assert drop_contaminated(docs, none).count() == docs.count()
    one = drop_contaminated(docs, bench, min_items=1)
    assert one.columns == docs.columns and one.where("text = 'no identifier'").count() == 0


@pytest.mark.parametrize("name", [None, 7])
def test_only_the_bad_row_of_an_identifier_goes(spark, name):
    bench = spark.createDataFrame([(2, "one two three four five six seven eight")], BENCH)
    rows = spark.createDataFrame([(name, "one two three four five six seven eight"), (name, "a clean text"), (name, None)], "doc_id long, text string")
    assert {r.text for r in drop_contaminated(rows, bench, min_items=1).collect()} == {"a clean text", None}
