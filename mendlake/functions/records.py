"""Small rules on records: public views, ids, kept tests, prompt gates, token slices, compact prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mendlake.functions.text import clip_middle, strip

# The longest texts of a problem and of a failing test that prompts hold.
PROBLEM_CHARS = {"question_title": 500, "question_id": 200, "platform": 200, "difficulty": 200, "question_content": 10000, "starter_code": 2500}


def public_view(evaluation: Column, *hidden: str) -> Column:
    """An evaluation struct without its long fields."""
    return evaluation.dropFields(*hidden)


def row_key(*parts: Column) -> Column:
    return F.concat_ws("|||", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def bug_uid(tag: Column, question: Column, code_idx: Column, running: Column) -> Column:
    """running: the row's number within its file."""
    return F.concat_ws("::", tag, question, code_idx.cast("string"), running.cast("string"))


def named(tag: Column, names: dict[str, str]) -> Column:
    """The name of a tag; tags without one name themselves."""
    table = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair]) if names else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(table, tag), tag)


def or_missing_id(task: Column, number: Column) -> Column:
    """An id made from the row's number where it is blank."""
    return F.when(F.coalesce(strip(task), F.lit("")) == "", F.concat(F.lit("__missing_task_id_"), number.cast("string"))).otherwise(task)


def passed_tests(tests: Column, ok: Column) -> Column:
    """The tests (array) whose flag in the parallel array ok is true; a missing flag is false."""
    return F.transform(F.filter(F.arrays_zip(tests.alias("t"), ok.alias("k")), lambda p: p["t"].isNotNull() & F.coalesce(p["k"], F.lit(False))), lambda p: p["t"])


def gold_asserts(asserts: Column, ok: Column) -> Column:
    """Distinct asserts about the candidate that the gold program passes, in order."""
    return F.array_distinct(F.filter(passed_tests(asserts, ok), lambda a: a.contains("candidate")))


def fitting_prompt(few_shot: Column, plain: Column, most: int) -> Column:
    """The prompt with examples if it is short enough, else the one without, else null: the row is to be dropped."""
    return F.when(F.length(few_shot) <= most, few_shot).when(F.length(plain) <= most, plain)


def generated_tokens(tokens: Column, prompt_length: Column, end_think: int) -> Column:
    """Token ids after the prompt and after the last end of reasoning."""
    made = F.slice(tokens, prompt_length + 1, F.greatest(F.size(tokens) - prompt_length, F.lit(0)))
    last = F.size(made) - F.array_position(F.reverse(made), F.lit(end_think)) + 1  # its place; size + 1 without one
    return F.when(F.array_contains(made, end_think), F.slice(made, last.cast("int") + 1, F.size(made))).otherwise(made)


def compact(record: dict[str, Column], limits: dict[str, int]) -> Column:
    return F.struct(*[clip_middle(record[k], n, k).alias(k) for k, n in limits.items() if k in record])
