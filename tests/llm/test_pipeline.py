import os

import corpus_pipeline
from test_dedup import brute_components, brute_fingerprint
from tidemark.llm.decontam import words_of


def test_stages_agree_with_brute_force(spark, tmp_path):
    import random

    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("ba", "co", "di", "fu") for b in ("n", "rst", "lk", "me", "te")]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, make(20)) for k in range(6)]
    docs = [(k, make(100)) for k in range(60)]
    docs += [(100 + k, " ".join(w + "***" for w in make(80).split())) for k in range(20)]
    docs += [(200, docs[0][1]), (201, docs[1][1] + " "), (202, f"{items[0][1]} and {items[1][1]}"), (203, items[2][1] + " " + make(50))]
    long = make(1500).split()
    for k in range(12):  # near copies, each with a word of its own
        docs.append((300 + k, " ".join([*long[: 100 * k], f"own{k}", *long[100 * k :]])))
    full = [(i, t, "en", "s", len(t)) for i, t in docs]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(not 100 <= i < 120), 0) for i, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = {}
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = table.columns
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, table, str(tmp_path))
        path = os.path.join(tmp_path, "out", name)
        out.write.parquet(path)
        table = spark.read.parquet(path)
        kept[name] = {r.doc_id for r in table.select("doc_id").collect()}
        assert name == "packing" or table.columns == columns
    everything = {i for i, _ in docs}
    assert kept["quality"] == everything - set(range(100, 120))
    assert kept["exact_dedup"] == kept["quality"] - {200, 1}  # 201 is longer than 1
    text = dict(docs)
    groups = brute_components({i: brute_fingerprint(text[i]) for i in kept["exact_dedup"]})
    assert kept["near_dedup"] == set(groups.values()) and len(kept["near_dedup"] & set(range(300, 312))) < 12
    grams = [{tuple(words_of(t)[k : k + 8]) for k in range(13)} for _, t in items]
    dirty = {i for i in kept["near_dedup"] if sum(any(tuple(words_of(text[i])[k : k + 8]) in g for k in range(len(words_of(text[i])) - 7)) for g in grams) >= 1}
    assert kept["decontaminate"] == kept["near_dedup"] - dirty and dirty == {202, 203}
    assert kept["packing"] == kept["decontaminate"]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()} == kept["packing"]
