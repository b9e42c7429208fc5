"""Comparison keys of messages and rotation families of file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quietlog import fixed_values as fv
from quietlog.functions.text import pattern


def _volatile(with_epoch: bool, digits: bool = True, colon: bool = True) -> str:
    """One alternation of all volatile parts, in their order, made cheap to fail.

    Nearly every position of a line fails, so alternatives that start with the same few
    characters stand behind one look-ahead, the time shapes behind one look-behind. Parts that need a
    digit or a colon are left out for texts that have none.
    """

    def behind(first: str, parts: list[str]) -> str:
        return f"(?={first})(?:{'|'.join(parts)})"

    tags = [t for t in fv.VOLATILE_TAGS if (colon or not t.endswith(":")) and (digits or not t.startswith("0x"))]
    if not digits:
        return pattern("|".join(tags), "(?iUd)")
    # A run of name characters is scanned from its first one (or where the last hit ended)
    # only: a scan from any later one would run into the same end.
    name = fv.VOLATILE_PROCESS[: fv.VOLATILE_PROCESS.index("+")]
    process = rf"(?:(?<!{name})|\G){fv.VOLATILE_PROCESS}"
    return pattern(
        "|".join([
            rf"(?<!\w)(?:{'|'.join(fv.VOLATILE_TIMES)})",
            *([fv.VOLATILE_EPOCH] if with_epoch else []),
            behind("[tp]", fv.VOLATILE_TASK_IDS),
            behind("l", fv.VOLATILE_LINE_IDS),
            behind(r"\d", [fv.VOLATILE_NUMBER]),
            process,
            *tags,
        ]),
        "(?iUd)",
    )


# A run of white space that is not just one blank.
_RUN = f"{fv.SPACE}{{2,}}|(?! ){fv.SPACE}"


def _key(message: Column, with_epoch: bool) -> Column:
    """The key; a text is searched only for the parts whose digits or colon it has."""
    digits, colon = message.rlike(pattern(r"\d")), message.contains(":")

    def blanked(has_digits: bool, has_colon: bool) -> Column:
        return F.regexp_replace(message, _volatile(with_epoch, has_digits, has_colon), " ")

    with_digits = F.when(colon, blanked(True, True)).otherwise(blanked(True, False))
    without = F.when(colon, blanked(False, True)).otherwise(blanked(False, False))
    stable = F.when(digits, with_digits).otherwise(without)
    return F.lower(F.trim(F.regexp_replace(stable, pattern(_RUN), " ")))


def normalize(message: Column) -> Column:
    """Key of a stripped message: times, ids, tags and levels blanked, lower case."""
    return _key(message, with_epoch=False)


def normalize_filewise(line: Column) -> Column:
    """Key of a raw line; epoch times with a fraction are blanked as well."""
    return _key(line, with_epoch=True)


def group_key(name: Column) -> Column:
    """Rotation family of a file name: one trailing ``.<digits>`` dropped."""
    return F.regexp_replace(name, pattern(fv.ROTATION_SUFFIX), "")
