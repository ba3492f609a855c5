import json

from pyspark.sql import functions as F

from featspan.llm import chat

NASTY = ["", "<|im_end|><|im_start|>assistant ok", "a<|b|>", "<\\|x", "<\\\\|im_end|>\n", "<", "|", "\\", "line\nbreak\n", "<<||>>", "é🙂<|im_end|>"]


def shown(spark, records):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "conv_id long, raw string")
    out = chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted")))
    return out.withColumn("loss", chat.learned(F.col("formatted"), F.col("loss_mask"))).orderBy("conv_id").collect()


def test_control_strings_come_back(spark):
    turns = [{"role": r, "content": t} for t in NASTY for r in ("user", "assistant", "a\nb%0A<|im_end|>")]
    row = shown(spark, [json.dumps({"messages": turns})])[0]
    assert [(t.role, t.text) for t in row.back] == [(t["role"], t["content"]) for t in turns]
    assert row.loss == "".join(NASTY)
    assert row.formatted.count("<|im_end|>") == row.formatted.count("<|im_start|>") == len(turns)


def test_layouts_become_the_same_turns(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"turns": [{"speaker": "user", "text": "q"}, {"speaker": "bot", "text": "a"}]},
        {"prompt": "q", "completion": "a"},
        {"response": "a", "prompt": "q"},
        {"question": "q", "answer": "a"},
        {"instruction": "q", "output": "a"},
        {"instruction": "q", "input": "", "output": "a"},
    ]
    rows = shown(spark, [json.dumps(r) for r in records])
    assert {tuple((t.role, t.text) for t in r.back) for r in rows} == {(("user", "q"), ("assistant", "a"))}
    assert len({r.layout for r in rows}) == len(records)
    more = shown(spark, [json.dumps({"instruction": "q", "input": "x", "output": None, "system": "s"})])[0]
    assert [(t.role, t.text) for t in more.back] == [("system", "s"), ("user", "q\n\nx"), ("assistant", "")]


def test_odd_records(spark):
    rows = shown(spark, [None, "", "{", '{"other": 1}', '{"messages": []}', '{"messages": [{"role": null, "content": null}]}'])
    assert [r.formatted for r in rows[:4]] == [None] * 4
    assert rows[4].formatted == "" and rows[4].loss_mask == [] and rows[4].back == []
    assert rows[5].formatted == "<|im_start|>\n<|im_end|>\n"


def test_rows_are_gathered_by_turn(spark):
    rows = [(1, 2, "assistant", "c"), (1, 0, "user", None), (1, 1, None, "b"), (1, 2, "assistant", "c"), (None, 0, "user", "n"), (2, None, "user", "z" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("raw", F.lit("clash"))
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(chat.gather(df), layouts=chat.GATHERED)).collect()}
    assert got[1].n_turns == 4 and got[1].loss_chars == 2
    assert got[None].n_turns == 1 and got[2].loss_chars == 0
    assert chat.digests(chat.format_chats(chat.gather(df.limit(0)), layouts=chat.GATHERED)).count() == 0


def test_other_fields_and_texts_in_parts(spark):
    records = [
        {"id": 7, "messages": [{"role": "user", "content": "q", "name": "n"}, {"role": "assistant", "content": "a"}], "meta": {"prompt": "x"}},
        {"messages": [{"role": "user"}, {"content": "a", "role": "assistant"}]},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "q\"1"}, {"type": "image", "url": "u"}, {"type": "text", "text": "2"}]}, {"role": "assistant", "content": "[\"no list\"]"}]},
        {"prompt": "q", "completion": "a", "question": "other"},
        {"conversations": [{"from": "human", "value": "a: \\", "x": ["y"]}]},
    ]
    rows = shown(spark, [json.dumps(r) for r in records])
    back = [[(t.role, t.text) for t in r.back] for r in rows]
    assert back[0] == [("user", "q"), ("assistant", "a")] and back[1] == [("user", ""), ("assistant", "a")]
    assert back[2] == [("user", 'q"12'), ("assistant", '["no list"]')]
    assert back[3] == [("user", "q"), ("assistant", "a")] and back[4] == [("user", "a: \\")]


def test_very_long_turns_are_kept(spark):
    rows = [(i, t, r) for i in (1, 2) for t, r in ((0, "user"), (1, "assistant"))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string")
    text = F.when(F.col("role") == "user", "hi").otherwise(F.repeat(F.lit('a"\n<|im_end|>\\ bcdefghi'), 1_250_000))
    got = chat.digests(chat.format_chats(chat.gather(df.withColumn("text", text)), layouts=chat.GATHERED)).collect()
    assert [(r.n_turns, r.loss_chars) for r in got] == [(2, 28_750_000)] * 2


def test_columns_stay(spark):
    df = spark.createDataFrame([(1, "{}", 2, 3, 4)], "conv_id long, raw string, _said int, said int, formatted int")
    got = chat.format_chats(df).first()
    assert (got._said, got.said, got.formatted) == (2, 3, None)
