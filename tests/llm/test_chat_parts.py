"""Operator 8: control strings that are split between parts."""
import random
import re

from pyspark.sql import types as T

from statuta.llm import chat_format as cf

SCHEMA = f"conv_id long, turn long, role string, parts {cf.PARTS}"
CONTROLS = ["<|turn|>", "<|body|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "<|image|0|>", "<\\|turn|>", "[\\\\/INST]"]


def part(text=None, kind="text", ref=None):
    return (kind, text, ref, None, None, None, None)


def back(spark, contents):
    """Segment, role and text of each list of parts."""
    df = spark.createDataFrame([(1, i, r, p) for i, (r, p) in enumerate(contents)], SCHEMA)
    formatted = cf.format_turns(df)
    segments = {r["turn"]: r for r in formatted.collect()}
    read = {r["turn"]: r for r in cf.read_back(formatted).collect()}
    return [(segments[i]["segment"], read[i]["role"], read[i]["text"], read[i]["loss_text"], segments[i]["attachments"])
            for i in range(len(contents))]


def check(spark, contents):
    for (role, parts), (segment, got_role, text, loss, attachments) in zip(contents, back(spark, contents)):
        expected = "".join(p[1] or "" for p in parts if p[0] not in cf.ATTACHED)
        assert (got_role, text) == (role, expected)
        assert loss == (expected if role == "assistant" else None)
        kinds = [p[0] for p in parts if p[0] in cf.ATTACHED]
        assert re.findall(r"<\|\w+\|(?:\d+\|)?>", segment) == (
            [cf.TURN, cf.BODY] + [f"<|{k}|{i}|>" for i, k in enumerate(kinds)] + [cf.END])
        assert not re.search(r"</?s>|\[/?INST\]", segment)
        assert [a["number"] for a in attachments] == list(range(len(kinds)))


def test_every_split_of_every_control_string(spark):
    contents = []
    for text in [*CONTROLS, "a<|end|>y", "<<|end|>", "<\\<|turn|>"]:
        for k in range(len(text) + 1):
            for between in ([], [part("")], [part(kind="image", ref="i")], [part(kind="audio"), part(kind="document")]):
                contents.append(("assistant" if k % 2 else "user", [part(text[:k]), *between, part(text[k:])]))
    check(spark, contents)


def test_random_parts(spark):
    rng = random.Random(8)
    pieces = ["<", "[", "\\", "|", "/", "s>", "INST]", "|turn|>", "|end|>", "body", "0|>", "x", "\n", "é", "</s>", "[INST]"]
    contents = []
    for _ in range(800):
        parts = [part(kind=rng.choice(cf.ATTACHED)) if rng.random() < 0.25
                 else part(rng.choice([None, "".join(rng.choices(pieces, k=rng.randint(0, 6)))]),
                           kind=rng.choice(["text", "other"]))
                 for _ in range(rng.randint(0, 7))]
        contents.append((rng.choice(["assistant", "user", "<|end|>", "<", "[INST]"]), parts))
    check(spark, contents)


def test_many_parts_of_one_turn(spark):
    parts = [part("<") if i % 3 else part(kind="image", ref=str(i)) for i in range(3_000)]
    (segment, _, text, _, attachments), = back(spark, [("user", parts)])
    assert text == "<" * 2_000 and len(attachments) == 1_000 and attachments[-1]["ref"] == "2997"


def test_schema_is_that_of_text_parts(spark):
    from pyspark.sql import functions as F

    df = spark.range(1).select(cf.text_parts(F.lit("x")).alias("parts"))
    assert [f.name for f in df.schema["parts"].dataType.elementType.fields][:3] == ["type", "text", "ref"]
    assert isinstance(df.schema["parts"].dataType, T.ArrayType)
