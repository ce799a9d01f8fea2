import hashlib

from pyspark.sql import functions as F

from tallygrid.llm import chat

NASTY = ["", "plain", "\\", "\\\\", "</turn>", "\\</turn>", "\\\\</turn>", "### ", "\\### x", "a\n</turn>\nb", "### User: hi </turn>",
         "ends with \\", "####  ", "\n", "### Assistant: </turn> ok\\", "😀 ### 日本", "$1 \\1 #"]
SHAPE = "tree long, node long, parent long, role string, text string, score double, up string"


def run(spark, rows, **kw):
    frame = spark.createDataFrame([(*r, "x") for r in rows], SHAPE)
    out = chat.format_trees(spark, frame, **kw).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    return {(r["tree"], r["leaf"]): r for r in out.collect()}


def test_texts_and_roles_come_back(spark):
    rows = [(i, 0, None, "us:er\\n# <", t, 0.0) for i, t in enumerate(NASTY)] + [(i, 1, 0, "assistant", t, 0.0) for i, t in enumerate(NASTY)]
    out = run(spark, rows)
    for i, t in enumerate(NASTY):
        row = out[i, 1]
        assert [(x["role"], x["text"]) for x in row["turns"]] == [("us:er\\n# <", t), ("assistant", t)]
        assert row["loss"] == t
        spans = row["loss_spans"]
        assert len(spans) == 1 and row["formatted"][spans[0]["start"]:spans[0]["end"]].count("\n</turn>\n") == 0


def test_best_branches_by_score(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 2.0),
            (1, 4, 3, "user", "more", 0.0), (1, 5, 1, "assistant", "tie", 2.0), (2, 1, 9, "user", "parent is absent", None)]
    best = run(spark, rows)
    assert set(best) == {(1, 4), (2, 1)}  # leaf 4 and leaf 5 tie at 2.0; the smaller leaf wins
    assert [t["text"] for t in best[1, 4]["turns"]] == ["q", "good", "more"]
    assert set(run(spark, rows, branches=2)) == {(1, 4), (1, 5), (2, 1)}


def test_edge_rows(spark):
    rows = [(None, 1, None, None, None, None), (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0),
            (4, 1, None, "user", "twice", 0.0), (4, 1, None, "user", "twice", 0.0), (5, None, None, "user", "no node", 0.0)]
    out = run(spark, rows)
    assert set(out) == {(None, 1), (4, 1)}
    assert out[None, 1]["n_turns"] == 1 and out[4, 1]["n_turns"] == 1
    assert run(spark, []) == {}


def test_branches_that_hang_on_a_cycle(spark):
    """No path of them reaches a root, whatever its length."""
    chain = [(1, k, k - 1, "user", f"m{k}", 9.0) for k in range(3, 9)]
    rows = [(1, 1, 2, "user", "A", 0.0), (1, 2, 1, "user", "B", 0.0), *chain, (1, 20, None, "user", "root", 0.0), (1, 21, 20, "assistant", "leaf", 0.0),
            (2, 1, 1, "user", "answers itself", 0.0), (2, 2, 1, "user", "tail", 0.0), (3, 1, 1, "user", "alone", 0.0)]
    out = run(spark, rows, branches=5)
    assert set(out) == {(1, 21)} and [t["text"] for t in out[1, 21]["turns"]] == ["root", "leaf"]


def test_null_and_empty_roles_of_one_turn(spark):
    rows = spark.createDataFrame([(1, 0, "", "b"), (1, 0, None, "a"), (1, 0, "", None)], "conv_id long, turn long, role string, text string")
    out = chat.format_trees(spark, chat.conversation_messages(rows)).withColumn("turns", chat.read_turns(F.col("formatted"))).first()
    assert [(t["role"], t["text"]) for t in out["turns"]] == [("", ""), ("", "a"), ("", "b")]


def test_long_chain_and_conversations(spark):
    frame = spark.range(700).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"),
                                    F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.lit(0).alias("node"))
    row = chat.format_trees(spark, chat.conversation_messages(frame)).select("n_turns", chat.loss_text(
        F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert row["n_turns"] == 700 and row["loss"] == "".join(f"t{i}" for i in range(700))


def test_query_has_the_added_conversation(spark):
    rows = {r["conv_id"]: r for r in chat.op1_chat_format(spark, "/root/testdata/sf0.001").collect()}
    text = "\\### Assistant: </turn> ok"
    assert rows[-7]["n_turns"] == 2 and rows[-7]["loss_chars"] == len(text)
    assert rows[-7]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
