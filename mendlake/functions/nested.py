"""JSON of changing shape to typed arrays, and prompts as arrays of messages."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendlake.functions.text import TARGET_CHARS, clip_middle, strip
from mendlake.schemas import TEST_CASE

# Names under which tests, and the inputs and outputs of the members of a list, are found.
CONTAINERS = ("tests", "test_cases", "public_test_cases", "private_test_cases")
INPUTS = ("input", "stdin", "test_input", "input_data")
OUTPUTS = ("output", "stdout", "expected_output", "test_output")
CASES = "array<struct<input:string,output:string>>"
CASES_TYPE = T.ArrayType(TEST_CASE)


def json_object(x: Column) -> Column:
    """The first JSON object (variant) in noisy text: of a fenced block, the whole text, or from the first brace to the
    last; null without any."""
    fence = F.regexp_extract_all(x, F.lit(r"(?i)```(?:json)?\s*([\s\S]*?)```"), 1)
    tried = F.concat(fence, F.array(strip(x), F.regexp_extract(x, r"(?s)\{.*\}", 0)))
    good = F.filter(tried, lambda y: F.coalesce(F.schema_of_variant(F.try_parse_json(y)).startswith("OBJECT"), F.lit(False)))
    return F.try_parse_json(F.get(good, F.lit(0)))


def typed_cases(x: Column) -> Column:
    """Test cases of JSON text in the common shape, a list of {input, output}; the fast path of any_cases()."""
    return F.filter(F.from_json(x, CASES), lambda c: c["input"].isNotNull() & c["output"].isNotNull())


def _named(x: dict, names: tuple[str, ...]) -> object:
    """The value of the first of names that x has, null or not; '' if it has none."""
    return next((x[n] for n in names if n in x), "")


def cases_of(x: object) -> list[tuple[str, str]]:
    """(input, output) of JSON text or of what it holds, at any depth: JSON text is read again, an object is a case or
    contains tests, and the members of a list are JSON texts or cases, where a missing side is '' and a null one drops
    the case. What is no text becomes Python's text of it."""
    out: list[tuple[str, str]] = []
    todo = [x]
    while todo:  # a stack, as JSON may hold JSON as deep as it likes
        y = todo.pop()
        if isinstance(y, str) and y.strip():
            try:
                todo.append(json.loads(y))
            except (ValueError, RecursionError):
                continue
        elif isinstance(y, dict):
            if "input" in y and ("output" in y or "expected_output" in y):
                out.append((str(y["input"]), str(_named(y, ("output", "expected_output")))))
            else:
                todo += [y[n] for n in CONTAINERS if n in y][:1]
        elif isinstance(y, list):
            members = [_Case(_named(z, INPUTS), _named(z, OUTPUTS)) if isinstance(z, dict) else z for z in y if isinstance(z, (str, dict))]
            todo += reversed(members)
        elif isinstance(y, _Case) and y.given is not None and y.wanted is not None:
            out.append((str(y.given), str(y.wanted)))
    return out


@dataclass(frozen=True)
class _Case:
    given: object
    wanted: object


@F.pandas_udf(CASES_TYPE)
def any_cases(x: pd.Series) -> pd.Series:
    """Test cases of JSON text of any shape, see cases_of(); none of null."""
    return x.map(lambda v: [{"input": a, "output": b} for a, b in cases_of(v)] if isinstance(v, str) else [])


NORMALISED = T.StructType().add("tests", CASES_TYPE).add("error", "string")


@F.pandas_udf(NORMALISED)
def normalised_tests(x: pd.Series) -> pd.DataFrame:
    """(tests, error) of generated JSON: a list, or an object with a list `tests`; members whose input and output are
    both texts, each pair once. The error says why there are none."""
    rows = []
    for text in x:
        try:
            y = json.loads(text) if isinstance(text, str) else None
        except (ValueError, RecursionError):
            y = None
        y = y.get("tests") if isinstance(y, dict) else y
        if not isinstance(y, list):
            rows.append(([], "JSON must be an object with key 'tests' containing a list"))
            continue
        pairs = dict.fromkeys((z["input"], z["output"]) for z in y if isinstance(z, dict) and isinstance(z.get("input"), str) and isinstance(z.get("output"), str))
        rows.append(([{"input": a, "output": b} for a, b in pairs], "" if pairs else "no valid tests after normalization"))
    return pd.DataFrame(rows, columns=["tests", "error"])


def official_cases(public: Column, private: Column, generated: Column, *others: Column) -> Column:
    """The three lists of a problem one after the other; if all are empty, the first of the others that isn't."""
    none = F.array().cast(CASES)
    return first_not_empty(F.concat(*[F.coalesce(a, none) for a in (public, private, generated)]), *others)


def as_text(x: Column) -> Column:
    """Bytes as UTF-8 text (broken bytes replaced), anything else as text, null as ''."""
    return F.coalesce(x.cast("string"), F.lit(""))


def metadata_text(x: Column, most: int = 4000) -> Column:
    """A struct or map as indented JSON, its first `most` characters; '' of null."""
    return F.coalesce(F.substring(F.to_json(x, {"pretty": "true"}), 1, most), F.lit(""))


def first_not_empty(*arrays: Column) -> Column:
    """The first array with a member, else an empty one."""
    return F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays], F.array().cast(CASES))


def distinct_cases(cases: Column) -> Column:
    """In order of their first occurrence, without those that lack a field."""
    return F.array_distinct(F.filter(cases, lambda c: c["input"].isNotNull() & c["output"].isNotNull()))


def zipped(index: Column, array: Column, default: object = None) -> Column:
    """Member at index of a list that may be shorter."""
    return F.coalesce(F.get(array, index), F.lit(default))


def first_content(completion: Column) -> Column:
    """The first message's content of an array of messages."""
    return F.coalesce(F.get(completion, F.lit(0))["content"], F.lit(""))


def messages(*parts: tuple[str, Column]) -> Column:
    """array<struct<role, content>>; null contents are empty."""
    return F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(text, F.lit("")).alias("content")) for role, text in parts])


DEBUG_SYSTEM = "You repair programs. Explain the failure briefly, then give the whole corrected program in one Python block."
WRITE_SYSTEM = "You write programs. Give the whole program in one Python block."
TEST_SYSTEM = "You write tests. Give one Python block that defines check(candidate) with at least ten asserts."
IO_TEST_SYSTEM = 'You write tests. Give JSON: {"tests": [{"input": ..., "output": ...}]}.'


def _section(title: str, text: Column) -> Column:
    return F.concat(F.lit(f"### {title}\n"), F.coalesce(text, F.lit("")), F.lit("\n\n"))


def debug_messages(problem: Column, code: Column, failing: Column, got: Column) -> Column:
    body = F.concat(_section("Problem", clip_middle(problem, 10000, "problem statement")), _section("Program", code), _section("Failing test", clip_middle(failing, 2500, "target")), _section("Result", clip_middle(got, 6000, "output")))
    return messages(("system", F.lit(DEBUG_SYSTEM)), ("user", body))


def assert_debug_messages(code: Column, failing_assert: Column) -> Column:
    """A program and the assert that it fails."""
    return messages(("system", F.lit(DEBUG_SYSTEM)), ("user", F.concat(_section("Program", code), _section("Failing test", failing_assert))))


def call_debug_messages(code: Column, given: Column, expected: Column, got: Column, entry: Column) -> Column:
    """A function, the input it fails on, what was expected and what it gave: values as literals, null as None."""
    value = lambda title, x: _section(title, F.coalesce(x, F.lit("None")))
    body = F.concat(_section("Program", code), value("Input", given), value("Expected", expected), value("Got", got), _section("Entry point", F.coalesce(F.nullif(entry, F.lit("")), F.lit("(unknown)"))))
    return messages(("system", F.lit(DEBUG_SYSTEM)), ("user", body))


def program_debug_messages(problem: Column, code: Column, given: Column, expected: Column, got: Column, stderr: Column) -> Column:
    """A program that reads stdin, its problem, and the test it fails; long parts are clipped in the middle."""
    clip = lambda x, name: clip_middle(x, TARGET_CHARS[name], name)
    test = F.concat(_section("Input", clip(given, "input")), _section("Expected", clip(expected, "expected")), _section("Got", clip(got, "got")), _section("Errors", clip(stderr, "stderr")))
    return messages(("system", F.lit(DEBUG_SYSTEM)), ("user", F.concat(_section("Problem", clip_middle(problem, 10000, "problem statement")), _section("Program", clip_middle(code, 6000, "buggy program")), test)))


def feedback(passed: Column, total: Column, failing: Column) -> Column:
    """What a program is told about its last attempt."""
    note = F.format_string("%d of %d tests pass.", passed, total)
    return F.when(passed >= total, note).otherwise(F.concat(note, F.lit(" The first that fails:\n"), F.coalesce(failing, F.lit(""))))


def generation_messages(problem: Column, starter: Column) -> Column:
    return messages(("system", F.lit(WRITE_SYSTEM)), ("user", F.concat(_section("Problem", clip_middle(problem, 10000, "problem statement")), _section("Starter code", clip_middle(starter, 2500, "starter code")))))


def self_repair_messages(problem: Column, code: Column, feedback: Column) -> Column:
    return messages(("system", F.lit(DEBUG_SYSTEM)), ("user", _section("Problem", problem)), ("assistant", code), ("user", _section("Feedback", feedback)))


def test_messages(problem: Column, shots: Column, io: bool = False) -> Column:
    """shots: array of struct(problem, tests) that come before the problem."""
    role = lambda who, text: F.struct(F.lit(who).alias("role"), text.alias("content"))
    turns = F.flatten(F.transform(shots, lambda s: F.array(role("user", s["problem"]), role("assistant", s["tests"]))))
    return F.concat(messages(("system", F.lit(IO_TEST_SYSTEM if io else TEST_SYSTEM))), turns, messages(("user", problem)))


def prompt_chars(chat: Column) -> Column:
    """Characters of the messages (structs of role and content) as JSON with a space behind each colon and comma, nulls
    as null; 2 of no messages, null of null."""
    spaces = F.greatest(4 * F.size(chat) - 1, F.lit(0))  # three in a message, one between two
    return F.length(F.to_json(chat, {"ignoreNullFields": "false"})) + spaces
