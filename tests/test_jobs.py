"""Jobs end to end: reports, test runs, history, streaming."""

import html
import json
import os
import re
import tarfile
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

import quietlog as ql
from quietlog.operators import duplicates as dup
from quietlog.operators import findings as fnd
from quietlog.operators import history as hist
from quietlog.operators import testruns as tr
from quietlog.plans import tables as tb
from quietlog.plans.jobs import analyze, record_analysis, summarize_test_runs
from quietlog.rules import Rules
from quietlog.sinks import reports as rep
from quietlog.streaming import duplicates_stream as dstream
from quietlog.streaming.findings_stream import stream_findings

LOG = """04:31:14 INFO [FooService.cpp:1] <up> & "running"
04:31:15 ERROR fine
not dated INFO
04:31:16 DEBUG password=abcdef failed
"""


def document(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_golden_counts(spark, sf):
    lines = tb.app_lines(spark, sf)
    for profile in ("cli", "web"):
        counts = {r["category"]: r["count"] for r in ql.analyze(lines, profile=profile).groupBy("category").count().collect()}
        assert counts == {"noisy": 375, "sensitive": 250, "severity": 274}
    groups = ql.find_duplicates(tb.app_entries(spark, sf)).agg(F.count("*"), F.sum("cnt")).first()
    assert tuple(groups) == (48, 889)
    filewise = ql.find_filewise_duplicates(tb.app_filewise(spark, sf)).agg(F.count("*"), F.sum("cnt"), F.count_distinct("grp")).first()
    assert tuple(filewise) == (169, 863, 5)
    documents = ql.find_duplicates(tb.document_entries(spark, sf)).agg(F.count("*"), F.sum("cnt")).first()
    assert tuple(documents) == (158, 436)
    per_source = ql.find_filewise_duplicates(tb.document_filewise(spark, sf)).agg(F.count("*"), F.count_distinct("grp")).first()
    assert tuple(per_source) == (42, 13)


def test_checks_run_once_per_line(spark, sf):
    text = ql.analyze(tb.app_lines(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("AKIA[0-9A-Z]") == 1


def test_findings_of_a_union_are_the_union(spark, sf):
    one, two = tb.app_lines(spark, sf), tb.device_lines(spark, sf)
    both = ql.analyze(one.unionByName(two))
    apart = ql.analyze(one).unionByName(ql.analyze(two))
    assert both.exceptAll(apart).count() == 0 and apart.exceptAll(both).count() == 0


@pytest.mark.parametrize("profile", ["cli", "web"])
def test_report_per_file(spark, tmp_path, profile):
    logs, out = tmp_path / "logs", tmp_path / "out"
    logs.mkdir()
    (logs / "a.log").write_text(LOG)
    (logs / "empty.log").write_text("")
    findings = ql.analyze_files(spark, str(logs), str(out), profile=profile)
    assert findings.count() == 4
    text = document(*out.glob("report=a.log-*"))
    titles = re.findall(r"<h2>(.*?)</h2>", text)
    assert titles == ["Noisy Logs", "Sensitive / PII Logs", "Severity Violations"]
    cells = re.findall(r"<tr><td>(\d+)</td><td><strong style='color:(.*?)'>(.*?)</strong></td><td>(.*?)</td><td>(.*?)</td></tr>", text)
    assert [c[0] for c in cells] == ["1", "4", "4", "4"]
    assert cells[0][1:3] == ("#0066cc", "Foo") and cells[1][1:3] == ("#888888", "Unknown")
    assert html.unescape(cells[0][4]) == LOG.splitlines()[0]
    assert ("Total Issues Found: 4" in text) == (profile == "web")
    assert text.startswith("<html>") and text.rstrip().endswith("</html>")
    assert document(*out.glob("report=empty.log-*")).count("No issues found in this section.") == 3


def test_duplicates_report(spark, tmp_path):
    (tmp_path / "d.log").write_text("\n".join(["x <1>", "x <1>"] + [f"04:31:{i:02d} hot" for i in range(8)] + ["once", ""]))
    ranked = ql.find_repeats_in(spark, str(tmp_path / "d.log"), str(tmp_path / "out")).orderBy("rank").collect()
    assert [(r["key"], r["cnt"]) for r in ranked] == [("hot", 8), ("x <1>", 2)]
    text = document(tmp_path / "out")
    assert "Total parsed: 11" in text and "Stats: {'ok': 11}" in text
    assert text.index("<td>8</td>") < text.index("<td>2</td>")
    assert text.count("<pre>") == 7 and "... and 3 more similar lines" in text
    assert "<pre>d.log: x &lt;1&gt;</pre>" in text


@pytest.mark.parametrize("content, expected", [("\n \n", "No logs found / parsing failed"), ("a\nb\n", "No duplicate logs found.</b><br>Total parsed: 2")])
def test_duplicates_report_without_groups(spark, tmp_path, content, expected):
    (tmp_path / "d.log").write_text(content)
    ql.find_repeats_in(spark, str(tmp_path / "d.log"), str(tmp_path / "out"))
    text = document(tmp_path / "out")
    assert expected in text and "<table" not in text and "</table>" not in text


def test_filewise_report(spark, tmp_path):
    (tmp_path / "d.log").write_text("b <\nb <\na\na\nc\nc\nc\n")
    (tmp_path / "d.log.1").write_text('q "&"\n')
    ql.find_filewise_repeats_in(spark, str(tmp_path / "d.log"), str(tmp_path / "out"))
    rows = re.findall(r"<tr><td>(\d+)</td><td>(.*?)</td></tr>", document(tmp_path / "out"))
    assert rows == [("3", "c"), ("2", "b &lt;"), ("2", "a")]


def test_large_plain_files_and_archives_are_read_whole(spark, tmp_path):
    line = "y" * 1_000_000 + "\n"
    (tmp_path / "d.log").write_text(line * 20 + "\n")
    (tmp_path / "d.log.1").write_text("z\n")
    found = ql.find_repeats_in(spark, str(tmp_path / "d.log"), str(tmp_path / "out")).collect()
    assert [r["cnt"] for r in found] == [20]
    assert "Stats: {'ok': 21, 'skip': 1}" in document(tmp_path / "out")
    assert [r["cnt"] for r in ql.find_filewise_repeats_in(spark, str(tmp_path / "d.log")).collect()] == [20]
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.log").write_text("same\nonce\n")
    with tarfile.open(folder / "b.TGZ", "w:gz") as tar:
        tar.add(tmp_path / "d.log", "d.log")
        tar.add(folder / "a.log", "c.log")
    found = ql.find_repeats_in(spark, str(folder)).collect()
    assert sorted(r["cnt"] for r in found) == [2, 2, 20]


def test_equal_safe_names_do_not_interleave(spark, tmp_path):
    tests = spark.createDataFrame(
        [("A.b", 0, "PASSED", "x"), ("A_b", 0, "PASSED", "y")], "test_name string, return_code int, status string, log_file string"
    )
    lines = spark.createDataFrame([(f, i, "04:31:14 INFO " + f) for f in "xy" for i in range(3)], "file string, line bigint, log string")
    ql.summarize_test_runs(tests, lines, report_path=str(tmp_path / "out"))
    text = document(*(tmp_path / "out" / "tests").glob("report=*"))
    assert text.count("<html>") == 2 and text.rindex("INFO x") < text.index("INFO y")


def test_components_from_a_file(spark, tmp_path):
    (tmp_path / "c.yml").write_text("files: {Foo.cpp: Front}\nmentions:\n- {texts: [alpha, beta], component: Greek}\n")
    own = ql.load_components(spark, str(tmp_path / "c.yml"))
    lines = spark.createDataFrame([("f", 1, "04:31:14 INFO [Foo.cpp:1]"), ("f", 2, "04:31:14 INFO beta"), ("f", 3, "04:31:14 INFO [Bar.cpp:1]")], "file string, line bigint, log string")
    assert [r["plugin"] for r in ql.analyze(lines, components=own).orderBy("line").collect()] == ["Front", "Greek", "Bar"]
    for broken in ("files: 3", "mentions: [{texts: []}]", "mentions: [{texts: [], component: x}]", "a: ["):
        with pytest.raises(ql.rules.RulesError):
            ql.parse_components(broken)


def test_listing(spark):
    text = "Main.\n  A\n  B  # GetParam() = 1\n\nTyped/0.  # TypeParam = int\n  C\nnote\n.\n  D\n Odd\nLast.\n  E.F\n  G.\n  H"
    rows = [("run", i, t) for i, t in enumerate(text.split("\n"))]
    df = spark.createDataFrame(rows, "listing string, line bigint, text string").repartition(4)
    names = [r["full_name"] for r in tr.parse_test_listing(df).orderBy("line").collect()]
    assert names == ["Main.A", "Main.B  # GetParam() = 1", "Main.C", "Last.E.F", "G.H"]


def test_test_runs_keep_null_apart_from_zero(spark, tmp_path):
    tests = spark.createDataFrame(
        [("S.A", 0, "PASSED", "a.txt"), ("S.B", 1, "FAILED", "b.txt"), ("S.C/1", -1, "TIMEOUT", "gone.txt"), ("S.D", -1, "ERROR: <x>", None)],
        "test_name string, return_code int, status string, log_file string",
    )
    lines = spark.createDataFrame(
        [("a.txt", 1, "no finding")] + [("b.txt", i, "04:31:14 INFO failed") for i in range(4)], "file string, line bigint, log string"
    )
    results = ql.summarize_test_runs(tests, lines, report_path=str(tmp_path / "out"))
    got = {r["test_name"]: (r["noisy_count"], r["total_issues"], r["band"]) for r in results.collect()}
    assert got == {"S.A": (0, 0, "low"), "S.B": (4, 8, "medium"), "S.C/1": (None, None, None), "S.D": (None, None, None)}
    assert ql.status_counts(tests).first().asDict() == {"total": 4, "passed": 1, "failed": 1, "errors": 2}
    assert ql.issue_totals(results).first()["total_issues"] == 8
    singles = {p.name for p in (tmp_path / "out" / "tests").glob("report=*")}
    assert singles == {"report=report_S_A.html", "report=report_S_B.html"}
    assert document(tmp_path / "out" / "tests" / "report=report_S_B.html").count("<strong style") == 8
    text = document(tmp_path / "out" / "summary")
    assert text.count("No log data") == 2 and 'href="report_S_B.html"' in text and "ERROR: &lt;x&gt;" in text
    assert "Passed: 1 | Failed: 1 | Errors/Timeouts: 2" in text and "Total Log Quality Issues: 8" in text


def test_history(spark, tmp_path):
    path = str(tmp_path / "history")
    lines = spark.createDataFrame(
        [("a.log", i + 1, x) for i, x in enumerate(LOG.splitlines())] + [("b.log", 1, "calm")], "file string, line bigint, log string"
    )
    for day in (1, 2, 3):
        at = datetime(2024, 1, day, tzinfo=timezone.utc)
        ql.record_analysis(ql.analyze(lines), ql.summarize_lines(lines, ql.Rules()), path, at=at)
    history = ql.read_history(spark, path)
    assert history.count() == 6 and history.select("run_id").distinct().count() == 6
    recent = ql.recent_history(history, 3).collect()
    assert [(r["timestamp"].day, r["filename"]) for r in recent] == [(3, "a.log"), (3, "b.log"), (2, "a.log")]
    totals = ql.history_totals(ql.recent_history(history, 3)).first()
    assert totals.asDict() == {"analyses": 3, "noisy_count": 4, "sensitive_count": 2, "severity_count": 2}
    assert ql.get_analysis(history, recent[0]["run_id"]).first()["total_issues"] == 4
    stored = ql.stored_findings(spark, path, recent[0]["run_id"])
    assert [r["line"] for r in stored.filter("category = 'noisy'").orderBy("line").collect()] == [1, 4]
    assert ql.stored_findings(spark, path, recent[1]["run_id"]).count() == 0 and ql.stored_findings(spark, path).count() == 12
    assert ql.get_analysis(history, "none").count() == 0
    ql.report_from_history(spark, path, recent[0]["run_id"], str(tmp_path / "again"))
    text = document(*(tmp_path / "again").glob("report=a.log-*"))
    assert "Total Issues Found: 4" in text and text.count("<strong style") == 4


def test_result_objects_and_lines(spark):
    lines = spark.createDataFrame([("a", i, f"04:31:14 INFO failed {i}") for i in range(20)] + [("b", 1, "04:31:14 INFO x")], "file string, line bigint, log string")
    findings, summaries = ql.analyze(lines), ql.summarize_lines(lines, ql.Rules())
    whole = {r["filename"]: json.loads(r["json"]) for r in rep.result_json(findings, summaries).collect()}
    assert list(whole["a"]) == ["filename", "summary", "noisy_logs", "sensitive_logs", "severity_violations"]
    assert [x["line"] for x in whole["a"]["severity_violations"]] == list(range(20))
    assert whole["a"]["summary"] == {"total_issues": 40, "noisy_count": 20, "sensitive_count": 0, "severity_count": 20}
    chunks = rep.result_json(findings, summaries, chunk_items=7).orderBy("filename", "chunk").collect()
    assert [(r["filename"], r["chunk"]) for r in chunks] == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    parts = [json.loads(r["json"]) for r in chunks[:3]]
    assert [x["line"] for p in parts for x in p["noisy_logs"]] == list(range(20))
    assert all(p["summary"] == whole["a"]["summary"] for p in parts)
    assert rep.result_lines(findings).count() == 41


def test_stream_equals_batch(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text(LOG)
    found = stream_findings(spark, str(logs))
    query = (
        found.writeStream.format("parquet").option("path", str(tmp_path / "sink"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "sink")).drop("line")
    batch = ql.analyze_files(spark, str(logs)).drop("line")
    assert got.exceptAll(batch).count() == 0 and got.count() == batch.count() == 4


def test_streamed_duplicates_equal_the_whole(spark, tmp_path):
    logs, whole = tmp_path / "logs", []
    logs.mkdir()
    for i in range(6):
        lines = [f"{h:02}:00:0{k % 10}.{i} INFO poll {k % 3} pid={k}" for h in (1, 2) for k in range(20)] + [f"only {chr(97 + i)} x", "", "same\x0csame"]
        (logs / f"{i}.log").write_text("\n".join(lines) + "\n")
        whole += [x.strip() for line in lines for x in line.split("\x0c") if x.strip()]
    entries = spark.createDataFrame([("f", i, m) for i, m in enumerate(whole)], "file string, ord bigint, message string")
    expected = {r["key"]: r["cnt"] for r in dup.find_duplicates(entries).collect()}
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = dstream.stream_entries(spark, str(logs), files_per_batch=2)
    dstream.write_running(stream, out, state, available_now=True).awaitTermination()
    assert {r["key"]: r["cnt"] for r in dstream.read_running(spark, out).collect()} == expected
    assert len(list((tmp_path / "out").glob("batch=*"))) >= 3
    # new files are added to the counts that are kept
    (logs / "new.log").write_text("same\nsame\n")
    dstream.write_running(dstream.stream_entries(spark, str(logs)), out, state, available_now=True).awaitTermination()
    assert {r["key"]: r["cnt"] for r in dstream.read_running(spark, out).collect()} == {**expected, "same": expected["same"] + 2}


def test_streamed_spans_are_closed_by_the_watermark(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    for i in range(4):  # a file per hour, in the order of their names and ages
        (logs / f"{i}.log").write_text("".join(f"2024-01-01 0{i}:{m:02}:00 INFO tick\n" for m in range(0, 60, 10)))
        os.utime(logs / f"{i}.log", (1_700_000_000 + i, 1_700_000_000 + i))
    (logs / "5.log").write_text("2024-01-01 00:59:00 INFO tick\n2024-01-01 09:00:00 INFO tick\n")  # too late for the first span
    spans = dstream.windowed_duplicates(dstream.stream_entries(spark, str(logs), files_per_batch=1))
    query = spans.writeStream.outputMode("append").format("memory").queryName("spans").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = {r["opens"].hour: (r["cnt"], r["first_at"].minute) for r in spark.sql("SELECT * FROM spans").collect()}
    assert rows == {h: (6, 0) for h in range(4)}


def test_lookup_of_one_run_reads_one_folder(spark, tmp_path, capsys):
    path = str(tmp_path / "history")
    lines = spark.createDataFrame(
        [(f"{i % 40}.log", i, f"01:02:03 INFO line {i}") for i in range(400)], "file string, line bigint, log string")
    found = analyze(lines)
    record_analysis(found, fnd.summarize_lines(lines, Rules()), path, run_id="r")
    run = hist.read_history(spark, path).orderBy("filename").first()
    one = hist.stored_findings(spark, path, run["run_id"])
    assert {r["file"] for r in one.collect()} == {run["filename"]} and one.count() == 10
    one.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(bucket" in plan and f"EqualTo(run_id,{run['run_id']})" in plan
    assert hist.stored_findings(spark, path).count() == 400


def test_reports_of_tests_that_share_a_log(spark, tmp_path):
    lines = spark.createDataFrame([("a.log", i, f"01:02:03 INFO {i}") for i in range(30)], "file string, line bigint, log string")
    tests = spark.createDataFrame(
        [("S.a", 0, "PASSED", "a.log"), ("S.b", 1, "FAILED", "a.log"), ("S.c", 0, "PASSED", None)],
        "test_name string, return_code int, status string, log_file string")
    summarize_test_runs(tests, lines, report_path=str(tmp_path / "r"))
    own = spark.read.text(f"{tmp_path}/r/tests").groupBy("report").agg(F.count_if(F.col("value").startswith("<tr><td>")).alias("n"))
    assert {r["report"]: r["n"] for r in own.collect()} == {"report_S_a.html": 30, "report_S_b.html": 30}


def test_scratch_is_released(spark):
    from quietlog.session import cut, drop_scratch, scratch_path, scratch_released

    kept = scratch_path(spark, "kept")
    with scratch_released(spark):
        inner = cut(spark.range(9).toDF("x"))
        inner.write.parquet(kept)
        where = inner.inputFiles()[0].rsplit("/", 1)[0]
    assert spark.read.parquet(kept).count() == 9
    assert spark.read.parquet(where).columns == ["nothing"]
    drop_scratch(spark)
    assert not os.path.exists(kept.removeprefix("file://"))
    assert cut(spark.range(3).toDF("x")).count() == 3


def test_lines_of_test_runs_are_checked_once(spark, tmp_path):
    """The counts, the ranges of the reports and the reports read the same findings."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def log(i):
        read.add(1)
        return f"12:00:0{i % 10} INFO [Foo.cpp:1] request failed" if i % 2 else "12:00:00 WARN fine"

    rows = spark.range(60).select(
        F.concat(F.lit("t"), F.col("id") % 3, F.lit(".log")).alias("file"), F.col("id").alias("line"), log("id").alias("log")
    )
    quiet = spark.createDataFrame([("q.log", 1, "no time ERROR")], "file string, line long, log string")
    tests = spark.createDataFrame(
        [(f"S.{i}", 0, "PASSED", f"{i}.log") for i in ("t0", "t1", "t2", "q", "none")], "test_name string, return_code int, status string, log_file string"
    )
    results = summarize_test_runs(tests, rows.unionByName(quiet), report_path=str(tmp_path / "r"))
    assert {r["test_name"]: r["total_issues"] for r in results.collect()} == {"S.t0": 20, "S.t1": 20, "S.t2": 20, "S.q": 0, "S.none": None}
    assert read.value == 60
    assert {p.name for p in (tmp_path / "r" / "tests").glob("report=*")} == {f"report=report_S_{i}.html" for i in ("t0", "t1", "t2", "q")}
