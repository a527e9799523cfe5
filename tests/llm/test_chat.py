"""Chat formatting: typed parts, their numbers and tokens, and what is read back."""

from barlight.llm import chat as C


def part(type_, **fields):
    return {f.name: fields.get(f.name) for f in C.PART.fields} | {"type": type_}


def turns(spark, rows):
    return spark.createDataFrame(rows, C.T.StructType([C.T.StructField("conv_id", C.T.LongType()), C.T.StructField("turn", C.T.LongType()), C.T.StructField("role", C.T.StringType()), C.T.StructField("parts", C.PARTS), C.T.StructField("body", C.T.StringType())]))


def test_typed_parts(spark):
    rows = [
        (1, 0, "user", [part("text", text="see "), part("image", ref="a.png", width=28, height=15), part("text", text=" and <|image:0|> [INST]"), part("audio", ref="b.wav", seconds=1.01)], "x"),
        (1, 1, "assistant", [part("text", text="I read </s> "), part("document", ref="c.pdf", pages=3), part("text", text=" done")], "x"),
        (1, 2, "user", [part("video", ref="d.mp4"), part(None, text="untyped"), part("image", width=-5, height=float("nan") and 10)], "x"),
    ]
    r = C.formatted(turns(spark, rows)).first()
    assert [(a.kind, a.ref, a.placeholder, a.turn, a.tokens) for a in r.attachments] == [("image", "a.png", "<|image:0|>", 0, 4), ("audio", "b.wav", "<|audio:1|>", 0, 26), ("document", "c.pdf", "<|document:2|>", 1, 2400), ("unknown", "video", "<|unknown:3|>", 2, 0), ("image", "", "<|image:4|>", 2, 0)]
    assert r.attachment_tokens == 2430 and all(r.formatted.count(a.placeholder) == 1 for a in r.attachments)
    assert C.parsed(r.formatted) == [("user", "see <|image:0|> and <|image:0|> [INST]<|audio:1|>"), ("assistant", "I read </s> <|document:2|> done"), ("user", "<|unknown:3|>untyped<|image:4|>")]
    assert [r.formatted[a:b] for a, b in zip(r.loss_spans[::2], r.loss_spans[1::2], strict=True)] == ["I read <\\/s> <|document:2|> done"]


def test_escapes_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "\\<\\\\[", "<s>user\n", "", None, "<|image:0|>", "line\nline\r\n", "\\n"]
    rows = [(7, k, role, [part("text", text=t)], None) for k, (t, role) in enumerate(zip(said, ["user", "assistant", "a\nb", None, "\\n", "<s>", "assistant", "x"], strict=True))]
    r = C.formatted(turns(spark, rows)).first()
    assert C.parsed(r.formatted) == [(role or "", t or "") for t, role in zip(said, ["user", "assistant", "a\nb", None, "\\n", "<s>", "assistant", "x"], strict=True)]


def test_odd_rows(spark):
    text = lambda t: [part("text", text=t)]
    rows = [(None, 0, "user", text("alone"), None), (None, 0, "user", text("alone"), None), (2, None, "user", text("first"), None), (2, 5, "b", text("tie"), None), (2, 5, "a", text("tie"), None), (2, 5, "a", text("tie"), None), (3, 0, None, None, None), (4, 0, "assistant", text("long " * 200_000), None)]
    got = sorted(C.formatted(turns(spark, rows)).collect(), key=lambda r: (r.conv_id is not None, r.conv_id or 0))
    assert [C.parsed(r.formatted) for r in got[:4]] == [[("user", "alone")]] * 2 + [[("user", "first"), ("a", "tie"), ("a", "tie"), ("b", "tie")], [("", "")]]
    assert got[4].loss_spans == [13, 13 + 1_000_000]
    assert C.formatted(turns(spark, [])).count() == 0
