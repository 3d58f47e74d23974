"""Chat templates on small conversations."""

from pyspark.sql import functions as F

from graphloom.operators import templates as T

SCHEMA = "t array<struct<query:string,answer:string>>"


def test_chat(spark):
    d = spark.createDataFrame([([("q {{idx}}", "a"), ("r", None)],), ([],), ([(None, None)],)], SCHEMA)
    chat = lambda name, **o: [r[0] for r in d.select(T.chat(F.col("t"), name, **o)).collect()]
    assert chat("belle", bos="<s>", eos="</s>")[0] == "<s>Human: q {{idx}}\n\nBelle: a</s>\n\n<s>Human: r\n\nBelle: "
    assert chat("belle", system=F.lit("S"))[0].startswith("S\n\nHuman: q")
    assert chat("chatglm2")[0] == "[gMASK]sop\n\n[Round 1]\n\n问：q {{idx}}\n\n答：a\n\n[Round 2]\n\n问：r\n\n答："
    assert chat("llama2_zh", bos="<s>", eos="</s>")[0] == "<s>[INST] <<SYS>>\nYou are a helpful assistant. 你是一个乐于助人的助手。\n<</SYS>>\n\nq {{idx}} [/INST]a</s><s>[INST] r [/INST]"
    assert chat("vanilla") == ["r", "", ""]
    assert chat("ziya")[1:] == ["", "<human>:\n<bot>:"]


def test_every_template(spark):
    d = spark.createDataFrame([([("q", "a"), ("r", "b")],)], SCHEMA)
    for name, t in T.TEMPLATES.items():
        pairs = d.select(T.pairs(F.col("t"), name, eos="</s>")).first()[0]
        assert len(pairs) == (2 if t.history else 1)
        assert all(x in p.prompt for x, p in zip("qr" if t.history else "r", pairs))
        assert pairs[-1].answer == ("b" if t.efficient_eos else "b</s>")
