"""Profiles, histograms, history, reports, generator, command line, registered queries."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from tidemark import api, plans
from tidemark.__main__ import main
from tidemark.functions.formats import abbreviate, format_bytes, format_compact, format_count, format_duration
from tidemark.functions.histogram import bucket_of, decade_of, lower_of, width_of
from tidemark.operators import profile as P
from tidemark.operators.advise import flatten_plan, with_findings
from tidemark.operators.history import ChangePolicy, changes
from tidemark.operators.render import cell, render, sparkline, wrapped
from tidemark.operators.report import Options, history_rows
from tidemark.operators.store import MemoryHistory, ParquetHistory
from tidemark.sources.generate import SCENARIOS, generate_events, write_log

SF = "/root/testdata/sf0.001"


def bucket(v):
    if v < 64:
        return v
    top = v.bit_length() - 1
    return (top - 4) * 32 + (v >> (top - 5)) - 32


def test_buckets(spark):
    values = sorted({0, 1, 63, 64, 65, 999, 1000, 1023, 1024, 10_000, *(2**k + d for k in range(6, 62) for d in (-1, 0, 1))})
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", bucket_of(F.col("v")).alias("b")).select("*", lower_of(F.col("b")).alias("low"), width_of(F.col("b")).alias("width"), decade_of(F.col("b")).alias("d")).collect()
    for r in rows:
        assert r.b == bucket(r.v) and r.low <= r.v < r.low + r.width and r.width <= max(1, r.low / 32)
    assert {r.v: r.d for r in rows if r.v in (1000, 10_000)} == {1000: 2, 10_000: 3}


def events(spark, rows):
    return spark.createDataFrame(rows, "class_id string, seq long, database string, query_time_us long, full_scan boolean, ts long")


def test_profile_of_a_class(spark):
    e = events(spark, [("A", 1, "shop", 100, True, 0), ("A", 2, "shop", 900, False, 20), ("A", 3, "analytics", 900, False, 10), ("B", 4, "", 812_345, False, 0)])
    a, b = P.class_profile(e).orderBy("class_id").collect()
    assert (a.calls, a.query_time_us_sum, a.query_time_us_mean, a.full_scan_ratio, a.first_seen, a.last_seen) == (3, 1900, 1900 / 3, 1 / 3, 10, 20)
    assert (b.first_seen, b.last_seen) == (0, 0)
    assert P.worst_sample(e).where("class_id = 'A'").first().worst_seq == 2
    assert [(r.name, r.n) for r in P.tally(e, "database").orderBy("class_id", "place").collect()] == [("shop", 2), ("analytics", 1)]
    assert P.latency_percentiles(e).where("class_id = 'B'").first()[1:] == (812_345,) * 3


def test_percentiles_are_close(spark):
    e = spark.range(1, 100_001).select(F.lit("A").alias("class_id"), F.col("id").alias("query_time_us"))
    r = P.latency_percentiles(e).first()
    for got, want in zip(r[1:], (50_000, 95_000, 99_000), strict=True):
        assert abs(got - want) / want < 0.02


def test_changes(spark):
    rows = [(k + 1, "A", 20, avg) for k, avg in enumerate((10_000.0, 10_000.0, 45_000.0, 2_000.0))] + [(1, "B", 5, 1e4), (2, "B", 50, 9e4), (1, "C", 20, 100.0), (2, "C", 20, 900.0)]
    got = changes(spark.createDataFrame(rows, "run_id long, class_id string, calls long, avg_time_us double")).orderBy("run_id").collect()
    assert [(r.run_id, r.direction, round(r.ratio, 4)) for r in got] == [(3, "regression", 4.5), (4, "improvement", round(2 / 45, 4))]
    assert changes(spark.createDataFrame(rows, "run_id long, class_id string, calls long, avg_time_us double"), ChangePolicy(least_calls=1, least_delta_us=1)).count() == 4


def test_formats():
    assert [format_duration(x) for x in (4e-5, 0.0123, 0.25, 2.5, 45, 90, 7260, 90_000, -1, math.inf)] == ["40 µs", "12.3 ms", "250 ms", "2.50 s", "45.0 s", "1m 30s", "2h 01m", "1d 01h", "-", "-"]
    assert [format_compact(x) for x in (3, 2.5, 42.7, 480_000, 1500, 2e6, 5e15)] == ["3", "2.5", "43", "480k", "1.5k", "2.0M", "5000T"]
    assert (format_count(1234567), format_bytes(100), format_bytes(1536), abbreviate("a \n b", 0), abbreviate("abcdef", 4)) == ("1,234,567", "100 B", "1.5 KB", "a b", "abc…")
    assert sparkline([0, 1, 100]) == " ▁█" and cell("a|b\nc") == "a\\|b c"


def test_top_k_stays_below_advice(spark):
    table = spark.range(100).select(F.col("id").alias("class_id"), F.lit("SELECT 1").alias("sql")).orderBy("class_id").limit(3)
    plan = with_findings(table)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and plan.index("ArrowEvalPython") < plan.index("TakeOrderedAndProject")


def test_generated_log_to_report_and_history(spark, tmp_path):
    path = f"{tmp_path}/log"
    write_log(spark, path, 1500, 3, files=3)
    plain = generate_events(spark, 1500, 3).where("not admin")
    report = api.analyze_file(spark, path, "CREATE TABLE orders (id int, customer_id int, status char(9), created_at datetime)", Options(top=6), split_bytes=60_000)
    assert report.totals["calls"] == plain.count() and report.totals["query_time_us_sum"] == plain.agg(F.sum("query_time_us")).first()[0]
    assert len(report.classes) == 6 and [c["rank"] for c in report.classes] == list(range(1, 7)) and 12 <= report.run["class_count"] <= len(SCENARIOS)
    assert report.run["skipped"] + report.totals["calls"] == 1500
    assert json.loads(render(report, "json"))["findings"] == report.severities
    told = json.loads(render(report, "json"))
    assert list(told) == ["tool", "run", "totals", "sort", "class_count", "findings", "classes"] and told["totals"]["events"] == plain.count()
    first = told["classes"][0]
    assert list(first)[:8] == ["rank", "id", "kind", "fingerprint", "label", "tables", "calls", "time_share"] and first["label"] == f"{first['kind']} {', '.join(first['tables'])}"
    assert first["query_time_us"]["max"] == first["sample"]["query_time_us"] and sum(first["latency_decades"]) == first["calls"] == sum(d["count"] for d in first["users"])
    assert render(report, "markdown").count("\n| ") >= 7 and "[critical]" in render(report, "text")
    text = api.analyze_text(spark, "".join(open(f"{path}/{n}").read() for n in sorted(os.listdir(path)) if n.startswith("part")), None, Options(top=0, sort="calls", database="POST"))
    assert text.run["filtered"] == 0 and len(text.classes) == report.run["class_count"]
    stores = [ParquetHistory(spark, f"{tmp_path}/history"), MemoryHistory(spark)]
    for s in stores:
        rows = history_rows(report, spark)
        assert (s.save(*rows), s.save(*rows), s.latest_run()) == (1, 2, 2)
        assert s.changes(2).count() == 0 and s.history(report.classes[0].class_id).count() == 2
    a, b = (sorted(map(str, s.classes(2).collect())) for s in stores)
    assert a == b
    for s in stores:
        s.delete(1)
        assert s.runs().count() == 1 and s.table("snapshots").where("run_id = 1").count() == 0
    with pytest.raises(ValueError, match="unknown format"):
        render(report, "xml")


def test_generator_is_deterministic(spark):
    a, b = generate_events(spark, 400, 5, 2), generate_events(spark, 400, 5, 7)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_plan_rows():
    rows = flatten_plan('{"query_block": {"ordering_operation": {"using_filesort": true, "nested_loop": [{"table": {"table_name": "a", "access_type": "ALL", "rows_examined_per_scan": 5, "filtered": "10.0"}}, {"table": {"table_name": "b", "key": "k"}}]}}}')
    assert [(r["table_name"], r["rows"], r["filesort"], r["temporary"]) for r in rows] == [("a", 5, True, False), ("b", 0, True, False)]


def test_lines_wrap():
    assert wrapped("a bb ccc " * 9, 24, "  ") and all(len(x) <= 24 for x in wrapped("a bb ccc " * 9, 24, "  ")) and wrapped("x" * 50, 20) == ["x" * 50]


def test_standard_input_is_analysed(spark, tmp_path, monkeypatch, capsys):
    import io
    import sys

    write_log(spark, f"{tmp_path}/log", 60, 3)
    data = b"".join(p.read_bytes() for p in (tmp_path / "log").glob("part*"))
    monkeypatch.setattr("tidemark.__main__._session", lambda: spark)
    monkeypatch.setattr(sys, "stdin", type("In", (), {"buffer": io.BytesIO(data)})())
    assert main(["analyze", "--format", "json", "-"]) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["totals"]["events"] + told["run"]["skipped"] == 60 and told["run"]["source"] == "-"


def test_settings_and_ports(tmp_path):
    from tidemark.ports import FileExplainer, FileSchemaSource, Settings

    assert Settings.from_env({"TIDEMARK_TOP": "7", "TIDEMARK_DISABLE": "ST001, select-star", "OTHER": "x"}).options() == Options(top=7, disabled_rules=("ST001", "select-star"))
    with pytest.raises(ValueError, match="TIDEMARK_TOP"):
        Settings.from_env({"TIDEMARK_TOP": "many"})
    (tmp_path / "b.sql").write_text("CREATE TABLE b (x int);")
    (tmp_path / "a.sql").write_text("CREATE TABLE a (x int);")
    assert FileSchemaSource(str(tmp_path)).ddl() == "CREATE TABLE a (x int);\nCREATE TABLE b (x int);"
    (tmp_path / "0A.json").write_text('{"query_block": {"table": {"table_name": "t", "access_type": "ALL"}}}')
    explainer = FileExplainer(str(tmp_path))
    assert [r["table_name"] for r in explainer.explain("0A", "SELECT 1")] == ["t"] and explainer.explain("0B", "SELECT 1") == [] and explainer.explain("0A", "DELETE FROM t") == []


def test_command_line(capsys):
    assert main(["fingerprint", "select", "1"]) == 0 and "select ?" in capsys.readouterr().out
    assert main(["advise", "delete from t", "--fail-on", "critical"]) == 2 and main(["advise", "select 1"]) == 0
    assert main(["advise", "--json", "select * from t"]) == 0 and main(["parse", "select a from"]) == 1 and main(["rules"]) == 0
    assert main(["nonsense"]) == 64 and main(["version"]) == 0 and main(["advise", "--disable", "nope", "select 1"]) == 1


@pytest.mark.parametrize("name", ["class_profile", "latency_percentiles", "rank_by_p95", "changes_lag", "advise_st001", "class_id", "log_round_trip"])
def test_queries_agree_with_sql(spark, name):
    import duckdb
    import pandas as pd

    frame = plans.QUERIES[name](spark, SF).toPandas()
    db = duckdb.connect()
    for t in os.listdir(SF):
        db.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    want = db.sql(plans.ORACLE[name]).df()
    assert sorted(frame.columns) == sorted(want.columns)
    plain = lambda d: sorted(str([None if pd.isna(v) else float(v) if isinstance(v, (int, float)) else v for v in r]) for r in d[sorted(d.columns)].astype(object).values.tolist())
    assert plain(frame) == plain(want)


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_stands_without_the_corpus_operators(tmp_path, pipeline):
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = shutil.copytree(here, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *([] if pipeline else ["corpus_pipeline.py"])))
    assert not (copy / "tidemark" / "llm").exists() and not (copy / "tests" / "llm").exists()
    script = "import __spark_entry__ as e, bench; from tidemark import plans; assert set(e.queries()) == set(plans.QUERIES) and set(e.oracle_sql()) == set(plans.ORACLE)"
    subprocess.run([sys.executable, "-B", "-c", script], cwd=copy, check=True, timeout=120)
    told = subprocess.run([sys.executable, "-B", "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert told.returncode == 0, told.stdout


def test_errors_within_the_corpus_operators_are_not_swallowed(tmp_path):
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = shutil.copytree(here, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    (copy / "tidemark" / "llm").mkdir()
    (copy / "tidemark" / "llm" / "__init__.py").write_text("")
    (copy / "tidemark" / "llm" / "queries.py").write_text("import a_module_that_is_not_there\n")
    told = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; e.queries()"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert told.returncode and "a_module_that_is_not_there" in told.stderr
