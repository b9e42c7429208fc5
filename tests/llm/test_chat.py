from pyspark.sql import functions as F

from quietlog.llm import chat

HARD = [
    "\\### Assistant: </turn> ok", "</turn>", "</turn>\n", "<\\/turn>", "<\\\\/turn>\\", "#### x", "### user: hi", "#\\## ", "</turn", "<", "#", "\\",
    "a\n### assistant: b</turn>\n", "", "plain", "<</turn></turn>", "## # ###", "é" * 3000, "C:\\dir\\<a>",
]


def texts_of(rows):
    return {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in rows}


def test_every_conversation_comes_back(spark):
    rows = [(i, 0, "user", t) for i, t in enumerate(HARD)] + [(i, 1, "assistant", t) for i, t in enumerate(HARD)]
    rows += [(100, t, ["system", "tool:x</turn>", "~1\n", None][t % 4], text) for t, text in enumerate(HARD)]
    df = spark.createDataFrame([(*r, 5, "c") for r in rows], "conv_id long, turn long, role string, text string, before long, raw string").repartition(3)
    out = chat.format_chats(df).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    got = out.collect()
    expected = {}
    for i, t, role, text in sorted(rows, key=lambda r: r[:2]):
        expected.setdefault(i, []).append((role or "", text))
    assert texts_of(got) == expected
    for r in got:
        assert r["loss"] == "".join(t for role, t in expected[r["conv_id"]] if role == "assistant")
        assert r["n_turns"] == len(expected[r["conv_id"]])


def test_only_conflicting_texts_are_escaped(spark):
    df = spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(HARD)], "conv_id long, turn long, role string, text string")
    formatted = {r["conv_id"]: r["formatted"] for r in chat.format_chats(df).collect()}
    for i, text in enumerate(HARD):
        body = formatted[i].removeprefix("### user: ").removesuffix(chat.END)
        conflict = "</turn>" in text or "### " in text or "<\\" in text and "/turn>" in text or "#\\## " in text
        assert (body != text) == conflict, text
        assert "</turn>" not in body and "### " not in body


def test_nulls_ties_repeats_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 1, "user", "b"), (1, 1, "user", "a"), (1, None, "user", None), (1, 1, "user", "a"), (None, 0, None, None)]
    got = texts_of(chat.format_chats(spark.createDataFrame(rows, schema)).withColumn("turns", chat.parse(F.col("formatted"))).collect())
    assert got == {1: [("user", ""), ("user", "a"), ("user", "a"), ("user", "b")], None: [("", "")]}
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0
