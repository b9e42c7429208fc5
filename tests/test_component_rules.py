"""Rules per component and ignore patterns, against plain Python."""

import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from quietlog.functions import features as ft
from quietlog.operators import component_rules as comp
from quietlog.operators import findings as fnd
from quietlog.plans import tables as tb
from quietlog.plans.jobs import analyze, analyze_components
from quietlog.rules import ComponentRule, Rules, RulesError, component_rules_table, declared_rules, parse_component_rules, parse_rules


def table(spark, rules):
    return component_rules_table(spark, Rules(component_rules=rules))


def lines(spark, rows):
    return spark.createDataFrame(rows, "file string, line bigint, log string")


def test_rules_from_yaml():
    assert {r.kind for r in declared_rules().component_rules} == {
        "critical_state", "warning_event", "sensitive_operation", "frequent_operation", "threshold"}
    bounds = [(r.name, r.grade, r.low, r.high) for r in declared_rules().component_rules if r.kind == "threshold"]
    assert Rules().component_rules == [] and Rules().ignore_patterns == []
    assert bounds == [("temperature", "warn", 65.0, 80.0), ("temperature", "critical", 80.0, float("inf"))]
    base = "sensitive_patterns: []\nfailure_keywords: []\nnoisy_log_levels: []\nrequired_severity_on_failure: []\n"
    bare = parse_rules(base)
    assert bare.component_rules == [] and bare.ignore_patterns == []
    given = parse_rules(base + "ignore_patterns: [a.*b]\ncomponent_rules: {X: {critical_states: [S], later: 1}}")
    assert given.component_rules == [ComponentRule("X", "critical_state", "S")] and given.ignore_patterns == ["a.*b"]
    for wrong in ({"X": {"thresholds": {"t_warn": "hot"}}}, {"X": {"frequent_operations": ["a"]}}, {"X": 3}, [1]):
        with pytest.raises(RulesError):
            parse_component_rules(wrong)


def test_mentions_equal_folded_columns(spark, sf):
    """The join with the rule table finds what one column per rule finds."""
    rules = declared_rules()
    found = comp.mention_findings(tb.component_lines(spark, sf), component_rules_table(spark, rules))
    dated = ft.with_component(tb.component_lines(spark, sf).select("file", "line", "log").filter(ft.has_timestamp(F.col("log"))))
    folded = reduce(lambda a, b: a.unionByName(b), [
        dated.filter((F.col("plugin") == r.component) & F.col("log").contains(r.name)).select(
            F.lit(r.kind).alias("category"), "file", "line", "plugin",
            F.lit(comp.MENTION_REASONS[r.kind] + r.name).alias("reason"), "log")
        for r in rules.component_rules if r.kind in comp.MENTIONS
    ])
    got = sorted(map(tuple, found.collect()))
    assert got and got == sorted(map(tuple, folded.collect()))


def test_event_time_of_all_shapes(column):
    def micros(days, h, m, s, us=0):
        return ((days * 24 + h) * 3600 + m * 60 + s) * 1_000_000 + us

    shapes = {
        "  2024-03-01 01:02:03.5 x": micros(19783, 1, 2, 3, 500000), "2024-03-01T01:02:03.000007Z x": micros(19783, 1, 2, 3, 7),
        "240301-01:02:03.250000 x": micros(19783, 1, 2, 3, 250000), "Feb 29 01:02:03 h": micros(789, 1, 2, 3),
        "Mar  1 01:02:03": micros(790, 1, 2, 3), "01:02:03.1234567 x": micros(0, 1, 2, 3, 123456), "01:02:03": micros(0, 1, 2, 3),
        "no time 01:02:03": None, "2024-02-31 01:02:03": None, "": None,
    }
    assert column(lambda: ft.event_micros(F.col("log")), list(shapes)) == list(shapes.values())


def test_readings(column):
    got = column(lambda: comp.readings(F.col("log")), ["Temp: -3.5 fan=2 x", "load is 7% of 9", "t5 6", "none", "Temperature 70, temperature = 81.25"])
    assert [[(r["name"], r["value"]) for r in g] for g in got] == [
        [("temp", -3.5), ("fan", 2.0)], [("load", 7.0), ("of", 9.0)], [("t", 5.0)], [], [("temperature", 70.0), ("temperature", 81.25)]]


def test_thresholds_by_range(spark):
    rules = parse_component_rules({"X": {"thresholds": {"temp_low": -10, "temp_high": 50, "fan_off": 0}}, "Y": {"thresholds": {"temp_any": 0}}})
    rows = [("f", i, f"01:02:03 [mod={c}] {t}") for i, (c, t) in enumerate(
        [("X", "temp -10.0"), ("X", "TEMP=49.9 fan 0"), ("X", "temp: 50"), ("X", "temp -10.5"), ("Y", "temp 7"), ("Z", "temp 99")])]
    got = comp.threshold_findings(lines(spark, rows), table(spark, rules)).collect()
    assert sorted((r["line"], r["value"], r["reason"]) for r in got) == [
        (0, -10.0, "Low threshold reached: temp -10.0 (from -10.0)"), (1, 0.0, "Off threshold reached: fan 0.0 (from 0.0)"),
        (1, 49.9, "Low threshold reached: temp 49.9 (from -10.0)"), (2, 50.0, "High threshold reached: temp 50.0 (from 50.0)"),
        (4, 7.0, "Any threshold reached: temp 7.0 (from 0.0)")]


@pytest.mark.parametrize("slice_seconds", [3600, 20, 1])
def test_frequencies_against_brute_force(spark, slice_seconds):
    """A component and a file with most of the lines, bursts at one instant, spans of two lengths."""
    rng = random.Random(4)
    rules = parse_component_rules({
        "Hot": {"frequent_operations": ["ping", "get"], "acceptable_frequency": 15},
        "Cold": {"frequent_operations": ["ping"], "acceptable_frequency": 2.5}, "None": {"critical_states": ["ping"]}})
    rows, seen = [], []
    for i in range(900):
        component = rng.choice(["Hot"] * 8 + ["Cold", "None"])
        file, at = rng.choice(["a"] * 5 + ["b"]), rng.choice([3600, rng.randrange(0, 9000), rng.randrange(0, 86000)])
        fraction = rng.choice([0, 500000, 1])
        text = rng.choice(["ping", "get", "ping get", "idle"])
        rows.append((file, i, f"{at // 3600:02}:{at // 60 % 60:02}:{at % 60:02}.{fraction:06} [mod={component}] {text}"))
        span = {"Hot": 15, "Cold": 2.5}.get(component)
        seen += [((file, component, op, span), at * 10**6 + fraction, i) for op in ("ping", "get") if op in text and span and (component, op) != ("Cold", "get")]
    expected = []
    for key, at, i in seen:
        same = [x for x in seen if x[:2] == (key, at)]
        if i == min(x[2] for x in same):
            within = sum(x[0] == key and at - key[3] * 10**6 < x[1] <= at for x in seen)
            if within > 1:
                expected.append((key[0], i, key[1], at, len(same), within))
    got = comp.frequency_findings(lines(spark, rows), table(spark, rules), slice_seconds=slice_seconds).collect()
    assert sorted((r["file"], r["line"], r["plugin"], r["at_micros"], r["n"], r["within"]) for r in got) == sorted(expected)
    assert max(x[4] for x in expected) > 40


def test_no_rules_no_findings(spark):
    rows = lines(spark, [("f", 1, "01:02:03 [mod=X] ping temp 3")])
    assert analyze_components(rows, Rules(component_rules=[])).count() == 0
    assert analyze_components(rows.limit(0)).count() == 0


def test_ignore_patterns_are_off_unless_asked_for(spark):
    rules = declared_rules()
    rows = lines(spark, [("f", 1, "01:02:03 INFO heartbeat error message password=abcdef1"), ("f", 2, "01:02:03 INFO up"),
                         ("f", 3, "01:02:03 INFO timer x succeeded, response success")])
    everything = analyze(rows, rules)
    assert {r["line"] for r in everything.collect()} == {1, 2, 3}
    kept = analyze(rows, rules, redaction="on", ignore=True).collect()
    assert {r["line"] for r in kept} == {2}
    counts = {(r["category"], r["ignored_by"]): r["n"] for r in fnd.count_ignored(everything, rules).collect()}
    assert counts == {("noisy", "heartbeat.*message"): 1, ("sensitive", "heartbeat.*message"): 1, ("severity", "heartbeat.*message"): 1,
                      ("noisy", "timer.*succeeded"): 1}
    assert everything.count() == len(kept) + sum(counts.values())
    assert analyze(rows, Rules(ignore_patterns=[]), ignore=True).count() == everything.count()
