"""Rules for the lines of single components: texts that count, readings in bounds, operations too often.

The rules are rows ``(component, kind, name, grade, low, high, seconds)`` joined by component, so
that a rule set of any size leaves the plan as it is. Only lines with an accepted timestamp count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietlog.functions import features as ft
from quietlog.functions.text import pattern
from quietlog.rules import Components
from quietlog.session import as_lookup, cut

MENTIONS = ("critical_state", "warning_event", "sensitive_operation")
MENTION_REASONS = {
    "critical_state": "Critical state: ", "warning_event": "Warning event: ", "sensitive_operation": "Sensitive operation: ",
}
# Shortest slice of time in which the occurrences of an operation are looked at together.
SLICE_SECONDS = 3600
_MICROS = 1_000_000
# A name, then a number: ``temperature: 81.5``, ``fan=3``, ``load is 7``.
_NAME, _NUMBER = r"([A-Za-z][A-Za-z_]*)", r"(-?\d+(?:\.\d+)?)"
READING = rf"\b{_NAME}[ \t]*(?:[=:]|is|of|at)?[ \t]*{_NUMBER}"


def _component_lines(lines: DataFrame, profile: str, components: Components | None, rules: DataFrame) -> DataFrame:
    """Dated lines of the components in ``rules`` (component, ...), with the columns of both."""
    dated = lines.select("file", "line", "log").filter(ft.has_timestamp(F.col("log"), profile))
    found = ft.with_component(dated, components=components)
    return found.join(as_lookup(rules), F.col("plugin") == F.col("component")).drop("component")


def mention_findings(
    lines: DataFrame, rules: DataFrame, profile: str = "cli", components: Components | None = None
) -> DataFrame:
    """``(category, file, line, plugin, reason, log)``: lines of a component that hold one of its
    critical states, warning events or sensitive operations; one finding per text."""
    texts = cut(rules.filter(F.col("kind").isin(*MENTIONS)).groupBy("component").agg(
        F.array_sort(F.collect_set(F.struct("kind", "name"))).alias("texts")
    ), "mentions")
    hit = F.filter("texts", lambda t: F.col("log").contains(t["name"]))
    found = _component_lines(lines, profile, components, texts).select("file", "line", "plugin", "log", F.explode(hit).alias("t"))
    return found.select(F.col("t.kind").alias("category"), "file", "line", "plugin", _mention_reason(), "log")


def _mention_reason() -> Column:
    texts = F.create_map(*[F.lit(x) for kv in MENTION_REASONS.items() for x in kv])
    return F.concat(F.element_at(texts, F.col("t.kind")), F.col("t.name")).alias("reason")


def readings(log: Column) -> Column:
    """array<struct<name, value>>: every name of a line that a number follows, in lower case."""
    name = F.regexp_extract_all(log, F.lit(pattern(READING, "")), F.lit(1))
    value = F.regexp_extract_all(log, F.lit(pattern(READING, "")), F.lit(2))
    return F.transform(
        F.arrays_zip(name.alias("name"), value.alias("value")),
        lambda r: F.struct(F.lower(r["name"]).alias("name"), r["value"].cast("double").alias("value")),
    )


def threshold_findings(
    lines: DataFrame, rules: DataFrame, profile: str = "cli", components: Components | None = None
) -> DataFrame:
    """Findings with ``value``: readings of a component that lie in the range of a grade.

    Readings meet the bounds in a join by component and name with the range as its condition;
    lines of components without bounds are dropped before numbers are looked for.
    """
    bounds = rules.filter(F.col("kind") == "threshold").select("component", F.lower("name").alias("name"), "grade", "low", "high")
    of_components = _component_lines(lines, profile, components, bounds.select("component").distinct())
    read = of_components.select("file", "line", "plugin", "log", F.explode(readings(F.col("log"))).alias("r"))
    b = as_lookup(bounds)
    inside = (
        (F.col("plugin") == b["component"]) & (F.col("r.name") == b["name"])
        & (F.col("r.value") >= b["low"]) & (F.col("r.value") < b["high"])
    )
    shown = F.concat(F.initcap(F.col("grade")), F.lit(" threshold reached: "), F.col("name"), F.lit(" "), F.col("r.value"),
                     F.lit(" (from "), F.col("low"), F.lit(")"))
    return read.join(b, inside).select(
        F.lit("threshold").alias("category"), "file", "line", "plugin", shown.alias("reason"), "log", F.col("r.value").alias("value")
    )


def frequency_findings(
    lines: DataFrame, rules: DataFrame, profile: str = "cli", components: Components | None = None,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Findings with ``at_micros``, ``n``, ``within``: operations that came again sooner than acceptable.

    One finding per file, operation and instant (``at_micros``, microseconds by the log's own clock)
    with ``n`` lines, of which the first is shown, if less than the acceptable seconds before it or at the same
    instant there is another occurrence; ``within`` counts all of that span.

    Occurrences are counted per instant map-side, then looked at in slices of time; the end of a
    slice, as long as the span, is handed to the next slice as well. So an operation that
    fills a third of all lines is spread over as many tasks as there are slices.
    """
    known = rules.filter((F.col("kind") == "frequent_operation") & F.col("seconds").isNotNull())
    texts = cut(known.groupBy("component").agg(F.collect_set(F.struct("name", "seconds")).alias("texts")), "operations")
    hit = F.filter("texts", lambda t: F.col("log").contains(t["name"]))
    found = _component_lines(lines, profile, components, texts).select("file", "line", "plugin", "log", F.explode(hit).alias("t"))
    timed = found.withColumn("at_micros", ft.event_micros(F.col("log"))).filter(F.col("at_micros").isNotNull())
    keys = ["file", "plugin", "operation", "seconds"]
    instants = cut(
        timed.groupBy("file", "plugin", F.col("t.name").alias("operation"), F.col("t.seconds").alias("seconds"), "at_micros")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("line", "log")).alias("first")), "instants",
    )
    spans = sorted(r["seconds"] for r in known.select("seconds").distinct().collect())  # as many as the rules name
    parts = [_too_often(instants.filter(F.col("seconds") == s), keys, int(s * _MICROS), slice_seconds * _MICROS) for s in spans]
    if not parts:
        parts = [instants.withColumn("within", F.col("n")).filter(F.lit(False))]
    often = parts[0]
    for part in parts[1:]:
        often = often.unionByName(part)
    why = F.concat(F.lit("Frequent operation: "), F.col("operation"), F.lit(" came "), F.col("within"), F.lit(" times within "),
                   F.col("seconds"), F.lit(" s"))
    return often.select(
        F.lit("frequent_operation").alias("category"), "file", F.col("first.line").alias("line"), "plugin", why.alias("reason"),
        F.col("first.log").alias("log"), "at_micros", "n", "within",
    )


def _too_often(instants: DataFrame, keys: list[str], span: int, length: int) -> DataFrame:
    """Instants with more than one occurrence in the ``span`` microseconds that end with them."""
    length = max(length, span, 1)
    slice_, place = F.floor(F.col("at_micros") / length), F.pmod("at_micros", F.lit(length))
    also_next = F.when(place > length - span, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    sliced = instants.withColumn("carried", F.explode(also_next)).withColumn("slice", slice_ + F.col("carried").cast("bigint"))
    frame = Window.partitionBy(*keys, "slice").orderBy("at_micros").rangeBetween(min(0, 1 - span), 0)
    return sliced.withColumn("within", F.sum("n").over(frame)).filter(~F.col("carried") & (F.col("within") > 1)).drop("carried", "slice")
