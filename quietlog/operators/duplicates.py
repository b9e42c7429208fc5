"""Groups of messages that say the same, over all files or per rotation family.

``entries`` is ``(file, ord, message)`` for the global form and ``(grp, ord, line)``
for the per-family form. ``ord`` is a number that grows in encounter order: with
numbers only in its buffers, grouping stays a hash aggregate with map-side combine.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietlog import fixed_values as fv
from quietlog.functions.normalize import normalize, normalize_filewise
from quietlog.operators.ordering import row_numbers

def concat_entries(*sources: DataFrame) -> DataFrame:
    """Entries of several sources one after another, ``ord`` kept in that order.

    A source begins behind the largest ``ord`` measured in those before it, so sources of
    any size and with any gaps keep their order. Numbers beyond 38 digits stop the job.
    """
    placed, base = [], 0
    for i, df in enumerate(sources):
        moved = F.col("ord").cast("decimal(38,0)") + F.lit(Decimal(base)).cast("decimal(38,0)")
        fits = F.when(F.col("ord").isNull() | moved.isNotNull(), moved).otherwise(
            F.raise_error(F.lit("no room for the order of the sources")).cast("decimal(38,0)"))
        placed.append(df.withColumn("ord", fits.cast("decimal(38,0)")))
        if i + 1 < len(sources):
            last = df.agg(F.max("ord").alias("last")).first()["last"]
            base += 0 if last is None else int(last) + 1
    return reduce(DataFrame.unionByName, placed)


# a key is never null: a null test inferred from a join would run the regexes once more


def with_key(entries: DataFrame) -> DataFrame:
    """Adds the comparison key. Entries that have one keep it, so it can be worked out
    once (and written, see :func:`quietlog.session.cut`) for several steps.
    """
    if "key" in entries.columns:
        return entries
    return entries.withColumn("key", F.coalesce(normalize(F.col("message")), F.lit("")))


def with_key_filewise(entries: DataFrame) -> DataFrame:
    if "key" in entries.columns:
        return entries
    return entries.withColumn("key", F.coalesce(normalize_filewise(F.col("line")), F.lit("")))


def _size():
    # an empty key counts nothing, so its group drops out with the singles; a filter on
    # the key itself would be pushed below the grouping and normalise every line twice
    return F.count(F.when(F.col("key") != "", F.lit(1)))


def find_duplicates(entries: DataFrame) -> DataFrame:
    """``(key, cnt, first_ord)`` of every message that occurs more than once."""
    groups = with_key(entries).groupBy("key").agg(_size().alias("cnt"), F.min("ord").alias("first_ord"))
    return groups.filter(F.col("cnt") > 1)


def find_filewise_duplicates(entries: DataFrame) -> DataFrame:
    """``(grp, cnt, line)`` with the first raw line of each repeated message of a family."""
    groups = (
        with_key_filewise(entries)
        .groupBy("grp", "key")
        .agg(_size().alias("cnt"), F.min_by("line", "ord").alias("line"))
    )
    return groups.filter(F.col("cnt") > 1).select("grp", "cnt", "line")


def first_examples(entries: DataFrame, groups: DataFrame, k: int = fv.EXAMPLES_PER_GROUP) -> DataFrame:
    """The first ``k`` entries of each group and how many more there are.

    The rank limit is applied before the shuffle too, so a hot message sends at most
    ``k`` rows per input partition. Join and window share one partitioning by key.
    """
    by_key = Window.partitionBy("key").orderBy("ord")
    leading = with_key(entries).withColumn("example", F.row_number().over(by_key))
    leading = leading.filter(F.col("example") <= k)
    more = F.greatest(F.col("cnt") - k, F.lit(0)).cast("bigint")
    return groups.join(leading, "key").select(
        "key", "cnt", "first_ord", F.col("example").cast("bigint"), "ord", "file", "message",
        more.alias("more"),
    )


def order_groups(groups: DataFrame) -> DataFrame:
    """Rank of global groups: most frequent first, ties in encounter order."""
    return row_numbers(groups, [F.col("cnt").desc(), F.col("first_ord").asc()])


def order_filewise(groups: DataFrame) -> DataFrame:
    """Rank inside each family: most frequent first, then the line, descending."""
    return row_numbers(groups, [F.col("cnt").desc(), F.col("line").desc()], ["grp"])


def duplicate_overview(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: lines parsed, duplicate groups, rows in them (and families, if per family)."""
    parts = [F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("rows_in_groups")]
    if "grp" in groups.columns:
        parts.append(F.count_distinct("grp").alias("families"))
    parsed = entries.agg(F.count(F.lit(1)).alias("parsed"))
    # two one-row tables side by side; a union keeps it free of a cross join
    found = groups.agg(*parts)
    both = parsed.unionByName(found, allowMissingColumns=True)
    return both.agg(*[F.max(c).cast("bigint").alias(c) for c in both.columns])
