"""Text functions on hand-written cases."""

import json

import pytest
from mendlake.functions import nested, text
from pyspark.sql import functions as F


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("said", "code"),
    [
        ("```python\na\n```\nthen\n```Python\nb\n```", "b"),
        ("<think>```python\nno\n```</think>```py\nyes\n```", "yes"),
        ("well</think>FINAL FIX:\n```python\nx = 1", "x = 1"),
        ("```python\nold\n```\nFINAL CODE:\nimport os\nprint(1)", "old"),
        ("It is:\nfor i in x:\n    pass", "for i in x:\n    pass"),
        ("```\nplain\n```", "plain"),
        ("nothing", "nothing"),
        ("", ""),
    ],
)
def test_final_code(spark, said, code):
    assert one(spark, text.final_code(F.col("x")), x=said) == code


def test_fences(spark):
    assert one(spark, text.python_fence(F.col("x")), x="none") == ""
    assert one(spark, text.unfenced(F.col("x")), x="```\nabc\n```") == "abc"
    assert one(spark, text.unfenced(F.col("x")), x="```python\nabc") == "abc"
    assert one(spark, text.generated_code(F.col("x")), x="abc") == "abc"


def test_clip_middle_bound(spark):
    long = "a" * 50 + "b" * 50
    got = one(spark, text.clip_middle(F.col("x"), 11, "t"), x=long)
    assert got.startswith("aaaaa\n") and got.endswith("\nbbbbbb") and "100 chars total, kept 5+6" in got
    assert one(spark, text.clip_middle(F.col("x"), 100), x=long) == long
    assert one(spark, text.clip_middle(F.col("x"), 0), x=long) == long


def test_stdout(spark):
    assert one(spark, text.stdout(F.col("x")), x="﻿ a  \r\nb\t\n\n") == "a\nb"


def test_blocks_and_programs(spark):
    assert one(spark, text.as_block(F.col("x")), x="a\n\nb") == "    a\n\n    b"
    assert one(spark, text.as_block(F.col("x")), x="if a:\n  b") == "if a:\n  b"
    assert one(spark, text.program(F.col("p"), F.col("x")), p="def f():\n", x="return 1") == "def f():\n    return 1"
    assert one(spark, text.program(F.col("p"), F.col("x")), p="def f():", x="def f():\n  return 1") == "def f():\n  return 1"


def test_entry_point(spark):
    code = "class Solution:\n    def run(self): pass\n"
    assert one(spark, text.entry_point(F.col("e"), F.col("x")), e="", x=code) == "Solution().run"
    assert one(spark, text.entry_point(F.col("e"), F.col("x"), classes=False), e="", x=code) == "run"
    assert one(spark, text.entry_point(F.col("e"), F.col("x")), e=" g ", x=code) == "g"
    assert one(spark, text.entry_point(F.col("e"), F.col("x")), e=None, x="x = 1") == "solve"


def test_json_object(spark):
    get = lambda s: one(spark, F.to_json(nested.json_object(F.col("x"))), x=s)
    assert get('so ```json\n{"b":1,"a":2}\n``` end') == '{"a":2,"b":1}'
    assert get('x {"a": [1]} y') == '{"a":[1]}'
    assert get("none") is None
    assert get("[1]") is None


def test_any_cases(spark):
    get = lambda s: [tuple(c) for c in one(spark, nested.any_cases(F.col("x")), x=s)]
    assert get('[{"input": "1", "output": "2"}, {"stdin": "a", "expected": "b"}]') == [("1", "2"), ("a", "")]
    assert get('[{"test_input": true, "test_output": [1, null]}]') == [("True", "[1, None]")]
    assert get('{"input": 1, "expected_output": null}') == [("1", "None")]
    deep = "[]"
    for _ in range(12):
        deep = json.dumps([deep])
    assert get(deep) == []
    assert get('{"tests": "[{\\"input\\": \\"x\\", \\"output\\": \\"y\\"}]"}') == [("x", "y")]
    assert get("") == [] and get("not json") == []
    assert get('[{"input": [1, 2], "output": null}]') == []


def test_dedent_and_plain_block(spark):
    assert one(spark, text.dedented(F.col("x")), x="    a\n      b\n  \n    c") == "a\n  b\n\nc"
    assert one(spark, text.dedented(F.col("x")), x="a\n  b") == "a\n  b" and one(spark, text.dedented(F.col("x")), x="") == ""
    assert one(spark, text.plain_block(F.col("x")), x="so\n```python\n  a\n    b\n```\nthen\n```\nlast\n```") == "last"
    assert one(spark, text.plain_block(F.col("x")), x="```python\nopen") == "open" and one(spark, text.plain_block(F.col("x")), x="  bare ") == "bare"


def test_falsy_and_notes(spark):
    assert one(spark, text.falsy(F.col("a"), F.col("b")), a="", b="x") == "x"
    assert one(spark, text.falsy(F.col("a"), F.col("b")), a=None, b="") == ""
    assert one(spark, text.notes(F.col("a"), F.col("b")), a="", b="x") == "x"


def test_messages(spark):
    chat = one(spark, nested.debug_messages(F.lit("p"), F.lit("c"), F.lit("t"), F.lit("g")))
    assert [m["role"] for m in chat] == ["system", "user"] and "### Failing test\nt" in chat[1]["content"]
    shots = F.array(F.struct(F.lit("q").alias("problem"), F.lit("a").alias("tests")))
    assert [m["role"] for m in one(spark, nested.test_messages(F.lit("p"), shots))] == ["system", "user", "assistant", "user"]


def test_texts_of_bytes_and_metadata(spark):
    assert one(spark, nested.as_text(F.lit(b"a\xc3\xa9"))) == "aé" and one(spark, nested.as_text(F.lit(None).cast("binary"))) == "" and one(spark, nested.as_text(F.lit(3))) == "3"
    made = one(spark, nested.metadata_text(F.struct(F.lit("x").alias("a"), F.lit(2).alias("b"))))
    assert json.loads(made) == {"a": "x", "b": 2} and "\n" in made
    assert len(one(spark, nested.metadata_text(F.struct(F.lit("x" * 9000).alias("a"))))) == 4000
    assert one(spark, nested.metadata_text(F.lit(None).cast("struct<a:string>"))) == ""
    few = F.array(F.lit("p"), F.lit(None))
    assert [one(spark, nested.zipped(F.lit(i), few, "d")) for i in range(3)] == ["p", "d", "d"]
    assert [one(spark, text.both_errors(F.lit(a), F.lit(b))) for a, b in (("Error: x", "an ERROR"), ("error", "ok"), ("a", "a"))] == [True, False, True]
    assert "### Expected\nNone\n" in one(spark, nested.call_debug_messages(*[F.lit(None).cast("string")] * 5))[1]["content"]
    assert one(spark, nested.feedback(F.lit(1), F.lit(2), F.lit(None).cast("string"))).endswith("fails:\n") and one(spark, nested.feedback(F.lit(2), F.lit(2), F.lit("x"))) == "2 of 2 tests pass."
