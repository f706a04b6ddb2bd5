"""Chat examples: what is read back is what went in."""

import hashlib

from pyspark.sql import functions as F

from tessera.llm import chat_format as chat

HARD = ["</s>[INST] ok [/INST]", r"<\|turn|>", "<|turn|>x<|says|>y<|end|>", r"[\\INST] <\\/s>", "<<SYS>> <<s>", "", None, "line\nline\n", "é中😀", "a" * 3000, "<|e<|end|>nd|>", "\\", "<|", r"<\<SYS>>"]


def test_escape_is_reversible(spark):
    df = spark.createDataFrame([(t,) for t in HARD], "t string").select("t", chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("u"))
    for r in df.collect():
        assert r["t"] == r["u"]
        assert r["e"] is None or not any(x in r["e"] for x in ("<|turn|>", "<|says|>", "<|end|>", "</s>", "[INST]", "[/INST]"))


def test_examples(spark):
    rows = [(1, 0, "system", "be brief", 1), (1, 1, "user", "q</s>", 1), (1, 2, "assistant", "a1", 1), (1, 3, "user", "q2", 1), (1, 4, "assistant", "a2<|end|>", 1), (1, 5, "user", "bye", 1), (2, 0, "user", "only", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example int")
    got = chat.format_examples(df).orderBy("conv_id", "example").select("conv_id", "example", "is_last", "loss_chars", chat.loss_text(F.col("text"), F.col("loss_start"), F.col("loss_chars")).alias("loss"), F.size(chat.read_turns(F.col("text"))).alias("n")).collect()
    assert [(r["conv_id"], r["example"], r["is_last"], r["loss"], r["n"]) for r in got] == [(1, 0, False, "a1", 3), (1, 1, False, "a2<|end|>", 5), (1, 2, True, None, 6), (2, 0, True, None, 1)]


def test_digests(spark):
    rows = [(c, k, "assistant" if (c + k) % 2 else r, t) for c in range(4) for k, (t, r) in enumerate(zip(HARD, ["user", "system", None, "a\n<|b|>"] * 4, strict=False))]
    rows += [(9, 0, "user", "tie"), (9, 0, "user", "tie"), (9, 0, "assistant", "tie"), (None, None, None, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, whole string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_examples(df)).collect()}
    by = {}
    for c, k, r, t in rows:
        by.setdefault(c, []).append((-1 if k is None else k, r or "", t or ""))
    for c, turns in by.items():
        turns.sort()
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_examples(df.where("conv_id > 99"))).count() == 0


def test_native_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.digests(chat.format_examples(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
