import hashlib
import re
from collections import Counter, defaultdict

import pytest
from xxhash import xxh64_intdigest

from tidemark.llm.components import components
from tidemark.llm.exact_dedup import drop_exact_copies, exact_groups
from tidemark.llm.simhash import _by_midpoints, drop_near_copies, near_groups, text_fingerprint


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize(("leaves", "lanes", "runs", "fan_in"), [(1, 1, 1, 2), (16, 2, 16, 2), (64, 4, 5, 4), (8, 8, 3, 8)])
def test_exact_groups(docs, rows_of, leaves, lanes, runs, fan_in):
    rows = [*rows_of, *rows_of[3:9], *rows_of[-3:]]  # repeated rows, with and without an identifier
    frame = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    want, stays = Counter(), set()
    for i, t in rows:
        best = min(groups[norm(t)])
        kept = (-len(t or ""), i is None, i or 0, i) == best and norm(t) not in stays  # one row of a text
        stays |= {norm(t)} if kept else set()
        want[(i, best[3], len(groups[norm(t)]), kept, hashlib.sha256(norm(t).encode()).hexdigest())] += 1
    got = exact_groups(frame, leaves=leaves, lanes=lanes, runs=runs, fan_in=fan_in)
    assert Counter(map(tuple, got.collect())) == want
    out = drop_exact_copies(frame, leaves=leaves, lanes=lanes, runs=runs, fan_in=fan_in).collect()
    assert Counter(norm(r.text) for r in out) == Counter(dict.fromkeys(groups, 1))
    assert {(r.doc_id, norm(r.text)) for r in out} == {(min(g)[3], t) for t, g in groups.items()}


def test_one_row_of_each_text_stays(spark, tmp_path):
    rows = [(1, "a b", 1), (1, "a b", 2), (2, "ab", 3), (3, "x", 4), (3, "ab", 5), (None, "y", 6), (None, "y", 7), (None, " ", 8), (4, None, 9), (None, None, 10)]
    spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3).write.parquet(f"{tmp_path}/d")
    from_files = spark.read.parquet(f"{tmp_path}/d")
    for frame in (from_files, from_files.where("n > 0"), spark.createDataFrame(rows, from_files.schema), from_files.union(from_files), from_files.join(spark.range(2))):
        out = drop_exact_copies(frame).collect()
        assert sorted(norm(r.text) for r in out) == ["", "ab", "x", "y"]
        assert {r.doc_id for r in out if norm(r.text) in ("ab", "x")} == {1, 3}


def test_a_round_moves_whole_runs(spark):
    from tidemark.llm import exact_dedup

    level = spark.range(200).selectExpr("cast(id % 2 as int) AS lane", "cast(id % 8 as int) AS run", "unhex(sha2(cast(id % 50 as string), 256)) AS digest", "1L AS width", "struct(id) AS best", "1L AS n")
    from pyspark.sql import functions as F

    merged = exact_dedup._round(level, F.floor(F.col("run") / 4), 2, 2)
    placed = merged.withColumn("part", F.spark_partition_id()).collect()
    assert len({(r.lane, r.run, r.part) for r in placed}) == len({(r.lane, r.run) for r in placed}) == 4  # a run lies in one partition
    for part in {r.part for r in placed}:
        digests = [bytes(r.digest) for r in placed if r.part == part]
        assert digests == sorted(set(digests))  # sorted, one row per digest
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortAggregate" in plan


def test_exact_dedup_of_nothing(empty):
    assert exact_groups(empty).count() == 0
    assert drop_exact_copies(empty).columns == empty.columns


def test_exact_filter_keeps_columns(docs):
    out = drop_exact_copies(docs)
    assert out.columns == docs.columns
    left = [norm(r.text) for r in out.select("text").collect()]
    assert set(left) == {norm(r.text) for r in docs.select("text").collect()}


def brute_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=4):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    values = sorted(set(prints.values()))
    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for i, f in prints.items():
        least[find(f)] = min(i, least.get(find(f), i))
    return {i: least[find(f)] for i, f in prints.items()}


def test_fingerprint_of_texts():
    for text in (None, "", " \t", "one", "One two THREE", "a b c d e f g É ß", "x " * 300):
        assert text_fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("limit", [16384, 3])
def test_near_groups(spark, docs, rows_of, limit):
    rows = [*rows_of, *rows_of[3:6], *rows_of[-3:], (None, "only without an identifier here")]  # repeated rows
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    group = brute_components({k: brute_fingerprint(t) for k, (_, t) in enumerate(rows)})
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(rows):
        if i is not None and (least[group[k]] is None or i < least[group[k]]):
            least[group[k]] = i
    want = Counter((i, f"{brute_fingerprint(t):016x}", least[group[k]]) for k, (i, t) in enumerate(rows))
    got = near_groups(frame, bucket_limit=limit).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert len({r.component_id for r in got if 200 <= (r.doc_id or 0) < 212}) < 12
    stays = [r for r in got if r.stays]
    assert len(stays) == len(set(group.values())) and all(r.doc_id == r.component_id for r in stays)
    left = drop_near_copies(frame, bucket_limit=limit).collect()
    assert Counter(r.doc_id for r in left) == Counter(r.doc_id for r in stays)


def test_random_fingerprints_lose_no_link(spark):
    import random

    from tidemark.llm import simhash
    from pyspark.sql import functions as F

    rng = random.Random(2)
    prints = {}
    for k in range(300):
        f = rng.getrandbits(64) if k % 3 == 0 else prints[k - 1] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6)))
        prints[k] = f
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    classes = spark.createDataFrame([(signed(f),) for f in set(prints.values())], "fp long")
    want = brute_components(prints)
    for blocks in (5, 6, 7):
        for limit in (16384, 2):
            filed = classes.select("fp", F.explode(simhash.bucket_keys(F.col("fp"), 4, blocks)).alias("k")).select("k.choice", "k.bits", "fp")
            linked = filed.repartition("choice", "bits").sortWithinPartitions("choice", "bits").mapInArrow(simhash._link(4, limit), "kind byte, u long, v long").cache()
            edges = linked.where("kind = 0").select("u", "v").union(_by_midpoints(linked.where("kind = 1").select("u"), 4))
            got = {r.node: r.component for r in components(edges).collect()}
            groups = defaultdict(set)
            for k, f in prints.items():
                groups[got.get(signed(f), signed(f))].add(k)
            assert all({want[k] for k in g} == {min(g)} for g in groups.values())


def test_near_dedup_of_nothing(empty):
    assert near_groups(empty).count() == 0
    assert drop_near_copies(empty).count() == 0


def test_near_filter_keeps_columns(docs):
    out = drop_near_copies(docs)
    assert out.columns == docs.columns
    assert out.count() == near_groups(docs).where("stays").count()


def test_components_of_chains_and_stars(spark):
    edges = [(k + 1, k) for k in range(50)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(1, 51)) and all(got[k] == 100 for k in range(101, 160)) and got[201] == 200
