"""Rule sets: read, check, write."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

import yaml
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietlog import fixed_values as fv
from quietlog.functions.text import pattern

RULES_SCHEMA = "kind string, ordinal int, value string"


class RulesError(ValueError):
    """A rule set that cannot be used."""


@dataclass(frozen=True)
class ComponentRule:
    """One rule for the lines of one component.

    ``kind`` is critical_state, warning_event or sensitive_operation (a text that counts where it stands),
    frequent_operation (a text that may not come again within ``seconds``) or threshold (a
    reading called ``name`` in [low, high) has the grade).
    """

    component: str
    kind: str
    name: str
    grade: str | None = None
    low: float | None = None
    high: float | None = None
    seconds: float | None = None


COMPONENT_RULE_SCHEMA = (
    "component string, kind string, name string, grade string, low double, high double, seconds double"
)
_LISTED_KINDS = {
    "critical_states": "critical_state", "warning_events": "warning_event",
    "sensitive_operations": "sensitive_operation", "frequent_operations": "frequent_operation",
}


def parse_component_rules(raw: Any) -> list[ComponentRule]:
    """Rules per component from a parsed mapping; keys that are not known have no effect.

    Thresholds are named ``<reading>_<grade>``; a grade holds from its bound up to the next
    greater one of the same reading.
    """
    out = []
    try:
        for component, given in (raw or {}).items():
            for key, kind in _LISTED_KINDS.items():
                seconds = float(given["acceptable_frequency"]) if kind == "frequent_operation" and given.get(key) else None
                out += [ComponentRule(str(component), kind, str(v), seconds=seconds) for v in given.get(key) or []]
            bounds: dict[str, list[tuple[float, str]]] = {}
            for name, bound in (given.get("thresholds") or {}).items():
                reading, _, grade = str(name).rpartition("_")
                bounds.setdefault(reading, []).append((float(bound), grade))
            for reading, grades in bounds.items():
                lows = sorted(grades)
                highs = [*[low for low, _ in lows[1:]], float("inf")]
                out += [
                    ComponentRule(str(component), "threshold", reading, grade, low, high) for (low, grade), high in zip(lows, highs)
                ]
    except (AttributeError, KeyError, TypeError, ValueError) as e:
        raise RulesError(f"component rules can't be used: {e!r}") from e
    return out


@dataclass(frozen=True)
class Rules:
    """The four lists that drive the three line checks, and what is applied on request only."""

    sensitive_patterns: list[str] = field(default_factory=lambda: list(fv.SENSITIVE_PATTERNS))
    failure_keywords: list[str] = field(default_factory=lambda: list(fv.FAILURE_KEYWORDS))
    noisy_log_levels: list[str] = field(default_factory=lambda: list(fv.NOISY_LOG_LEVELS))
    required_severity_on_failure: list[str] = field(
        default_factory=lambda: list(fv.REQUIRED_SEVERITY_ON_FAILURE)
    )
    ignore_patterns: list[str] = field(default_factory=list)
    component_rules: list[ComponentRule] = field(default_factory=list)

    def as_dict(self) -> dict[str, list[str]]:
        return {kind: list(getattr(self, kind)) for kind in fv.RULE_KINDS}


def declared_rules() -> Rules:
    """The default lists together with the ignore patterns and component rules declared beside them."""
    return Rules(ignore_patterns=list(fv.IGNORE_PATTERNS), component_rules=parse_component_rules(fv.COMPONENT_RULES))


@dataclass(frozen=True)
class Components:
    """Names of a site's components: by source file, and by texts a line mentions (in order)."""

    of_file: dict[str, str] = field(default_factory=lambda: dict(fv.COMPONENT_OF_FILE))
    of_mention: list[tuple[list[str], str]] = field(default_factory=lambda: list(fv.COMPONENT_OF_MENTION))


def parse_components(text: str) -> Components:
    """Components from YAML text: ``files`` maps names, ``mentions`` lists ``texts`` and ``component``."""
    try:
        raw = yaml.safe_load(text) or {}
        files = {str(k): str(v) for k, v in (raw.get("files") or {}).items()}
        mentions = [([str(t) for t in m["texts"]], str(m["component"])) for m in raw.get("mentions") or []]
    except (yaml.YAMLError, AttributeError, KeyError, TypeError) as e:
        raise RulesError(f"components can't be used: {e}") from e
    if not all(texts for texts, _ in mentions):
        raise RulesError("a mention lists no texts")
    return Components(files, mentions)


def load_components(spark: SparkSession, path: str) -> Components:
    """Components from a YAML file on any file system Spark can read."""
    text = spark.read.text(path, wholetext=True).head()
    return parse_components(text[0] if text else "")


def validate_rules(raw: Any) -> Rules:
    """Check a parsed mapping; ``ignore_patterns`` and ``component_rules`` may be missing, further
    keys are allowed and have no effect."""
    if not isinstance(raw, dict):
        raise RulesError("rules are empty or not a mapping")
    missing = [kind for kind in fv.RULE_KINDS if raw.get(kind) is None]
    if missing:
        raise RulesError("rules lack required keys: " + ", ".join(missing))
    return Rules(
        **{kind: [str(v) for v in raw[kind]] for kind in fv.RULE_KINDS},
        ignore_patterns=[str(v) for v in raw.get("ignore_patterns") or []],
        component_rules=parse_component_rules(raw.get("component_rules")),
    )


def parse_rules(text: str) -> Rules:
    """Rules from YAML text."""
    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise RulesError(f"rules are not valid YAML: {e}") from e
    return validate_rules(raw)


def _skip_class(regex: str, at: int) -> int:
    """Place behind the character class that opens at ``at``."""
    at += 2 if regex[at + 1:at + 2] == "^" else 1
    at += regex[at:at + 1] == "]"
    while regex[at] != "]":
        at += 2 if regex[at] == "\\" else 1
    return at + 1


def _skip_group(regex: str, at: int) -> int:
    """Place behind the group that opens at ``at``."""
    depth = 0
    while True:
        char = regex[at]
        if char == "[":
            at = _skip_class(regex, at)
            continue
        depth += (char == "(") - (char == ")")
        at += 2 if char == "\\" else 1
        if not depth:
            return at


def _plain_runs(regex: str) -> list[str]:
    """Runs of plain characters that stand in every match, at the top level of a pattern."""
    runs, at = [""], 0
    while at < len(regex):
        char, plain = regex[at], None
        if char == "|":
            return [""]
        if char == "(":
            at = _skip_group(regex, at)
        elif char == "[":
            at = _skip_class(regex, at)
        elif char == "\\":
            plain = regex[at + 1] if not regex[at + 1].isalnum() else None
            at += 2
        else:
            plain = char if char not in ".^$" else None
            at += 1
        quantifier = re.match(r"([?*+]|\{\d+(?:,\d*)?\})[?+]?", regex[at:])
        if plain is None or quantifier and quantifier[1] != "+":
            runs.append("")
        else:
            runs[-1] += plain
            if quantifier:
                runs.append("")
        at += quantifier.end() if quantifier else 0
    return runs


def required_text(regex: str) -> tuple[str, bool] | None:
    """Plain text every match of a pattern contains, and whether its case is ignored.

    Lines without that text need not be searched. This is the longest run of plain
    characters at the top level of the pattern; None if there is none to speak of. Flags
    other than a leading ``(?i)`` and quoted parts are not looked into.
    """
    ignore_case = regex.startswith("(?i)")
    body = regex.removeprefix("(?i)")
    if re.search(r"\(\?[a-zA-Z]*(-[a-zA-Z]+)?\)|\\[QpPxu0ck]", body):
        return None
    try:
        text = max(_plain_runs(body), key=len)
    except IndexError:  # not a valid pattern
        return None
    if len(text) < 3 or not text.isascii():
        return None
    return (text.lower() if ignore_case else text), ignore_case


def check_patterns(spark: SparkSession, rules: Rules) -> Rules:
    """Fail early on a pattern the JVM's regex engine does not accept."""
    one = spark.range(1)

    def accepted(patterns: list[str]) -> bool:
        try:
            one.select(*[F.lit("").rlike(pattern(p)).alias(f"p{i}") for i, p in enumerate(patterns)]).collect()
        except PySparkException:
            return False
        return True

    patterns = [*rules.sensitive_patterns, *rules.ignore_patterns]
    if patterns and not accepted(patterns):
        refused = [p for p in patterns if not accepted([p])]
        raise RulesError("not valid patterns: " + ", ".join(refused))
    return rules


def load_rules(spark: SparkSession, path: str) -> Rules:
    """Rules from a YAML file on any file system Spark can read."""
    try:
        text = spark.read.text(path, wholetext=True).head()
    except Exception as e:
        raise RulesError(f"cannot read rules from {path}: {e}") from e
    return check_patterns(spark, parse_rules(text[0] if text else ""))


def rules_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """The rule set as rows ``(kind, ordinal, value)``."""
    rows = [(k, i, v) for k, values in rules.as_dict().items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def component_rules_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """The component rules as rows, for the operators that join them."""
    rows = [(r.component, r.kind, r.name, r.grade, r.low, r.high, r.seconds) for r in rules.component_rules]
    return spark.createDataFrame(rows, COMPONENT_RULE_SCHEMA)


def rules_from_table(table: DataFrame) -> Rules:
    """Inverse of :func:`rules_table`; a kind without rows is an empty list."""
    values: dict[str, list[str]] = {kind: [] for kind in fv.RULE_KINDS}
    for row in table.orderBy("kind", "ordinal").collect():  # a rule set is small by nature
        values.setdefault(row["kind"], []).append(row["value"])
    return validate_rules(values)


def save_rules(spark: SparkSession, raw: Any, path: str) -> Rules:
    """Check, then replace the stored rule set (a one-row YAML text)."""
    rules = check_patterns(spark, validate_rules(raw))
    text = yaml.safe_dump(raw, default_flow_style=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return rules
