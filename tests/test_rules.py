"""Reading, checking and writing rule sets."""

import pytest
import yaml

from quietlog import fixed_values as fv
from quietlog.rules import (
    Rules, RulesError, load_rules, parse_rules, required_text, rules_from_table, rules_table, save_rules,
    validate_rules,
)

GOOD = {"sensitive_patterns": ["a+"], "failure_keywords": [], "noisy_log_levels": ["INFO"], "required_severity_on_failure": ["ERROR"], "note": 1}


def test_defaults():
    sizes = {k: len(v) for k, v in Rules().as_dict().items()}
    assert sizes == {"sensitive_patterns": 20, "failure_keywords": 24, "noisy_log_levels": 3, "required_severity_on_failure": 2}


def test_validation():
    assert validate_rules(GOOD).failure_keywords == []
    for raw in (None, [], "text"):
        with pytest.raises(RulesError):
            validate_rules(raw)
    with pytest.raises(RulesError, match="failure_keywords, noisy_log_levels"):
        validate_rules({**GOOD, "failure_keywords": None, "noisy_log_levels": None})
    with pytest.raises(RulesError, match="YAML"):
        parse_rules("a: [")


def test_round_trips(spark, tmp_path):
    path = str(tmp_path / "rules")
    save_rules(spark, GOOD, path)
    assert load_rules(spark, path) == validate_rules(GOOD)
    save_rules(spark, Rules().as_dict(), path)  # replaces
    assert load_rules(spark, path) == Rules()
    assert rules_from_table(rules_table(spark, Rules())) == Rules()
    assert rules_table(spark, validate_rules(GOOD)).count() == 3
    plain = tmp_path / "rules.yml"
    plain.write_text(yaml.safe_dump(GOOD))
    assert load_rules(spark, str(plain)) == validate_rules(GOOD)


def test_bad_files_and_patterns(spark, tmp_path):
    with pytest.raises(RulesError):
        load_rules(spark, str(tmp_path / "none.yml"))
    (tmp_path / "empty.yml").write_text("")
    with pytest.raises(RulesError):
        load_rules(spark, str(tmp_path / "empty.yml"))
    before = str(tmp_path / "kept")
    save_rules(spark, GOOD, before)
    with pytest.raises(RulesError, match=r"patterns: \($"):
        save_rules(spark, {**GOOD, "sensitive_patterns": ["a", "("]}, before)
    assert load_rules(spark, before) == validate_rules(GOOD)  # a refused set changes nothing


def test_every_kind_has_a_default():
    assert list(Rules().as_dict()) == fv.RULE_KINDS


@pytest.mark.parametrize("regex, expected", [
    ("abcd", ("abcd", False)), ("(?i)Abc:+x", ("abc:", True)), (r"\bab\b", None), ("abc|abd", None), ("ab(cde|f)ghij", ("ghij", False)),
    (r"x[abc\]]defg?h", ("def", False)), (r"a\.b\[c", ("a.b[c", False)), ("abcd{2,3}", ("abc", False)), ("abcd*", ("abc", False)),
    ("ab+cde", ("cde", False)), ("[]ab]cdef", ("cdef", False)), ("(a(b)[)]c)defg", ("defg", False)), ("(?i:abc)def", ("def", False)),
    ("abc(", None), (r"\Qab.c\E", None), ("(?x) a b c d", None), ("", None), ("äöüß", None),
])
def test_text_a_pattern_cannot_do_without(regex, expected):
    assert required_text(regex) == expected


def test_default_patterns_mostly_have_such_a_text():
    found = [required_text(p) for p in Rules().sensitive_patterns]
    assert sum(v is not None for v in found) >= 12
