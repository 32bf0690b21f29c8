from pyspark.sql import functions as F

from coralint.llm.chat_format import CONTROLS, PART, escape, format_conversations, read_loss, read_turns, unescape

HARD = ["", "plain", "\\", "\\\\e", "\\l", "\\b[INST]", "<|turn|>", "<<|turn|>|turn|>", "</s>[INST] ok [/INST]", "a<b [c]", "<|end|><|text|>\n", "é<|im_end|>"]


def test_escape_is_reversible_and_leaves_no_marker(spark):
    df = spark.createDataFrame([(t,) for t in HARD], "t string").select("t", escape(F.col("t")).alias("e"))
    for t, e, back in df.select("t", "e", unescape(F.col("e"))).collect():
        assert back == t
        assert not any(c in e for c in CONTROLS)


def test_round_trip_with_mask(spark):
    rows = [(c, i, role, t) for c in (1, 2) for i, (role, t) in enumerate(zip(["system", "user", "assistant"] * 4, HARD))]
    rows += [(3, None, None, None), (4, 0, "assistant", None), (4, 0, "assistant", None), (None, 1, "user", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    out = format_conversations(df).select("*", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.conv_id: r for r in out.collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for c, r in got.items():
        mine = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in mine]
        assert r.loss == "".join(x[3] or "" for x in mine if x[2] == "assistant")


def test_parts_become_ordered_placeholders(spark):
    part = lambda kind, **v: (kind, v.get("text"), v.get("uri"), v.get("width"), v.get("height"), v.get("seconds"), v.get("pages"))
    parts = [part("text", text="see "), part("image", uri="i", width=56, height=29), part("text", text=" and "), part("audio", uri="a", seconds=2.0), part("document", uri="d", pages=3), part("other")]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn int, role string, parts array<{PART}>")
    r = format_conversations(df).first()
    assert "see <|image|> and <|audio|><|document|><|end|>" in r.formatted
    assert [(a.kind, a.uri, a.tokens) for a in r.attachments] == [("image", "i", 4), ("audio", "a", 50), ("document", "d", 3072)]
    assert r.attachment_tokens == 3126


def test_clashing_names_and_empty_table(spark):
    schema = "conv_id long, turn int, role string, text string, ts string, at int, body string"
    df = spark.createDataFrame([(1, 0, "user", "hi", "x", 1, "y")], schema)
    assert format_conversations(df).count() == 1
    assert format_conversations(df.limit(0)).count() == 0


def test_markers_split_over_parts_are_no_markers(spark):
    part = lambda kind, text=None: (kind, text, None, None, None, None, None)
    parts = [part("text", "a<|en"), part("text", "d|>b"), part("other", "x"), part("text", "</"), part(None), part("text", "s>\\"), part("text", "p<"), part("image"), part("text", "|end|>")]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", parts[:2])], f"conv_id long, turn int, role string, parts array<{PART}>")
    r = format_conversations(df).select("*", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [t.text for t in r.turns] == ["a<|end|>b</s>\\p<<|image|>|end|>", "a<|end|>b"]
    assert r.loss == "a<|end|>b"
    assert r.formatted.count("<|end|>") == 2 and "</s>" not in r.formatted
