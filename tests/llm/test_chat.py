import hashlib
import itertools

from pyspark.sql import functions as F

from tabscope.llm.chat import CONTROL_STRINGS, conversation_digest, escape, prefix_target_examples, unescape

SCHEMA = "conv_id long, turn long, role string, text string, key string, rendered string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_escapes_are_reversible_and_leave_no_control_string(spark):
    parts = [*CONTROL_STRINGS, "\\", "<", "|", ">", "/", "s>", "[", "x\n", "é"]
    texts = ["".join(p) for n in range(4) for p in itertools.product(parts, repeat=n)]
    df = spark.createDataFrame([(x,) for x in texts], "x string").withColumn("e", escape(F.col("x")))
    rows = df.withColumn("back", unescape(F.col("e"))).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert row["back"] == row["x"], row
        assert not any(mark in row["e"] for mark in CONTROL_STRINGS), row


def test_examples_and_digests(spark):
    rows = [
        (1, 0, "system", "be brief"), (1, 2, "assistant", "b\\</s>"), (1, 1, "user", "</s>[INST] a <|x|>"), (1, 3, "user", "c"),
        (1, 4, "assistant", None), (2, 0, "user", None), (3, 0, "assistant", ""), (4, 0, None, "x"), (4, 0, "assistant", "y"),
        (4, 0, "assistant", "y"), (None, 0, "user", "u"), (None, 1, "assistant", "v" * 50_000), (5, None, "assistant", "z"),
        (5, 1, "<|odd|>", "w"),
    ]
    df = spark.createDataFrame([(*row, "k", "r") for row in rows], SCHEMA)
    examples = prefix_target_examples(df)
    got = {r["conv_id"]: r for r in conversation_digest(examples).collect()}
    groups = {}
    for row in rows:
        groups.setdefault(row[0], []).append(row)
    assert set(got) == set(groups)
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        row = got[conv]
        assert row["n_turns"] == len(own)
        assert row["turns_sha256"] == sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own))
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), sha(loss))
    own = [r for r in examples.orderBy("example").collect() if r["conv_id"] == 1]
    assert [r["example"] for r in own] == [3, 5]
    assert own[1]["formatted"].startswith(own[0]["formatted"]) and own[1]["is_last"] and not own[0]["is_last"]
    first = own[0]
    assert first["formatted"][first["loss_start"] :][: first["loss_chars"]] == "b\\\\<\\/s>"
    assert first["formatted"].endswith("</s>") and first["formatted"].count("</s>") == 3


def test_empty_table_and_no_python(spark):
    empty = conversation_digest(prefix_target_examples(spark.createDataFrame([], SCHEMA)))
    assert empty.collect() == []
    assert "Python" not in empty._jdf.queryExecution().toString()
