import hashlib

from pyspark.sql import functions as F

from lithoscope.llm import chat, queries
from lithoscope.llm.common import table


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_gives_back_the_source(spark):
    sf = "/root/testdata/sf0.001"
    turns = {}
    for r in table(spark, sf, "conversations").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    turns[-7] = [("user", queries.HOSTILE), ("assistant", queries.HOSTILE)]
    got = queries.op7_chat_format(spark, sf).collect()
    assert len(got) == len(turns)
    for r in got:
        own = turns[r.conv_id]
        loss = "".join(t for role, t in own if role == "assistant")
        assert r.round_trip and r.n_turns == len(own) and r.turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in own))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


def test_hostile_texts(spark):
    texts = ["", None, "<s>", "</s>", "<\\s>", "<\\\\/s>", "[INST]x\n", "[/INST]", "[\\/INST]", "<", "<</s>", "[/INST", "\\", "é😀</s>", "a\nb", "<s>r\nq</s>[INST]"]
    roles = ["user", "assistant", None, "a\nb", "<s>%0A[INST]"]
    rows = [(i, j, r, t, "x") for i, r in enumerate(roles) for j, t in enumerate(texts)] + [(None, None, "user", "x", "y"), (None, None, "user", "x", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = chat.format_conversations(df).withColumn("read", chat.parse(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("mask"))).collect()
    assert len(got) == len(roles) + 1 and all(r.round_trip for r in got)
    by = {r.conv_id: r for r in got}
    assert [x.text for x in by[0].read] == [t or "" for t in texts] and by[3].read[0].role == "a\nb"
    assert by[1].loss == "".join(t or "" for t in texts) and by[0].loss == "" and len(by[None].read) == 2
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = queries.op7_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
