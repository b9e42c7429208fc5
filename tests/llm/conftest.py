import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that operators use inside, as extra columns of the input.
CLASH = {"spans": "x", "id": 1, "kept": True, "fp": 5, "n": 2, "key": "k", "items": "i", "hit_spans": "h", "word": "w", "prefix": 3}


def frame(spark, texts, clash=False, parts=3):
    """documents from {doc_id: text} or [(doc_id, text)]."""
    rows = list(texts.items()) if isinstance(texts, dict) else list(texts)
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({k: F.lit(v) for k, v in CLASH.items()})
    return df.repartition(parts) if parts else df


@pytest.fixture
def documents(spark):
    def make(texts, **kwargs):
        return frame(spark, texts, **kwargs)

    return make


@pytest.fixture
def rng():
    return random.Random(7)
