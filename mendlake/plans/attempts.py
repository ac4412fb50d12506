"""Wide logs of attempts: a row of text for each attempt, in the columns of a benchmark's log.

An attempt is a row with evaluations as structs (passed, total, acc_pct, problem_passed, target_ok; null where nothing
was run), the sources of the three choices, and texts. A layout says which of its fields stand in which column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendlake.functions.text import notes
from mendlake.operators.evaluate import pct
from mendlake.operators.selection import Policy, backtrack, route
from mendlake.sources.sinks import log_rows
from mendlake.tables import apart

COUNTS = ("passed", "total")
RATES = (*COUNTS, "acc_pct")
ALL = (*RATES, "problem_passed")
EVALUATION = (*ALL, "target_ok")
#: The choices of an attempt: without a gate, gated by the official tests, gated by generated tests.
CHOICES = ("nonbacktracking", "oracle", "generated")
CHARS = ("debug_prompt_chars", "generation_prompt_chars", "debug_output_chars", "generation_output_chars")
#: Notes of attempts, fixed values.
NO_TARGET, NO_VERIFIER, NO_PROMPT = "skipped_no_failing_asserts", "skipped_missing_or_empty_verifier", "missing_generation_query"


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


def _group(prefix: str, field: str, measures: tuple[str, ...]) -> dict[str, str]:
    return {f"{prefix}_{m}": f"{field}.{m}" for m in measures}


def _verifiers(generation: str) -> dict[str, str]:
    return _group("verifier_debug", "verifier_debug", COUNTS) | _group(f"verifier_{generation}", "verifier_generation", COUNTS)


_GATES = _group("rl_backtracking_baseline_verifier", "verifier_baseline", COUNTS) | _group("rl_backtracking_selected_verifier", "verifier_selected", COUNTS)
_CODES = {"debug_code_full": "debug_code", "generation_code_full": "generation_code", "selected_code_full": "selected_code"}
_TARGETS = _same("target_input", "target_expected", "target_got_baseline", "target_got_selected")


def _chosen(measures: tuple[str, ...]) -> dict[str, str]:
    oracle, generated = "backtracking_with_oracle_tests", "backtracking_with_rl_generated_tests"
    out = _same("selected_source") | _group("nonbacktracking", "nonbacktracking", measures)
    out |= {f"{oracle}_source": "oracle_source"} | _group(oracle, "oracle", measures)
    return out | {f"{generated}_source": "generated_source"} | _group(generated, "generated", measures)


#: Column to field, in the order of each benchmark's log. The names of columns are fixed values.
LAYOUTS: dict[str, dict[str, str]] = {
    "assert": _same("experiment", "task_id", "question_id")
    | {"assert_index": "target_idx"}
    | _group("baseline_full_suite", "baseline", RATES)
    | _group("debug_full_suite", "debug", RATES)
    | _group("gen_full_suite", "generation", RATES)
    | _verifiers("gen")
    | _GATES
    | _chosen(RATES)
    | _same("target_ok", "debug_prompt_chars")
    | {"gen_prompt_chars": "generation_prompt_chars", "debug_output_chars": "debug_output_chars", "gen_output_chars": "generation_output_chars"}
    | _same("entry_point", "note")
    | _CODES,
    "io_list": _same("experiment", "task_id", "target_idx")
    | _group("baseline", "baseline", RATES)
    | _group("debug", "debug", RATES)
    | _group("generation", "generation", RATES)
    | _verifiers("generation")
    | _same("selected_source")
    | _group("nonbacktracking", "nonbacktracking", RATES)
    | {"backtracking_source": "oracle_source"}
    | _group("backtracking", "oracle", RATES)
    | _same("target_ok", *CHARS)
    | _TARGETS
    | _same("note")
    | _CODES,
    "stdin": _same("experiment", "bug_uid", "question_id", "bug_source_model_tag", "target_idx")
    | _group("baseline", "baseline", ALL)
    | _group("debug", "debug", ALL)
    | _group("generation", "generation", ALL)
    | _verifiers("generation")
    | _chosen(ALL)
    | _GATES
    | _same("target_ok", *CHARS)
    | _TARGETS
    | _same("note")
    | _CODES,
}


def evaluation(**fields: Column) -> Column:
    """An evaluation: passed and total, with what follows from them unless it is given."""
    passed, total = fields["passed"], fields["total"]
    all_passed = (total > 0) & (passed == total)
    known = {"acc_pct": pct(passed, total), "problem_passed": all_passed, "target_ok": F.lit(False)} | fields
    return F.struct(*[known[m].alias(m) for m in EVALUATION])


def skip_reason(has_failing: Column, verifier_total: Column | None = None) -> Column:
    """Why a problem isn't attempted, blank if it is: no test fails, or (where a verifier is needed) it has no tests.
    An unknown has_failing counts as none, an unknown total as no tests."""
    out = F.when(~F.coalesce(has_failing, F.lit(False)), NO_TARGET)
    if verifier_total is not None:
        out = out.when(F.coalesce(verifier_total, F.lit(0)) <= 0, NO_VERIFIER)
    return out.otherwise("")


def reselected_note(old: Column, new: Column) -> Column:
    """Blank if the target is the selected test."""
    return F.when(old != new, F.format_string("reselected_assert_from_%d_to_%d", old, new)).otherwise("")


def chosen(attempts: DataFrame, policy: Policy) -> DataFrame:
    """attempts (baseline, debug, generation; the tests of verifiers as verifier_debug, verifier_generation and
    verifier_baseline; debug_sample, generation_sample, debug_code, generation_code, buggy_code, note) with the three
    choices, their sources, target_ok, verifier_selected and selected_code.

    Without a candidate in either branch the buggy program is chosen. Without generated tests it is by the gate of
    generated tests, and the note says so.
    """
    wide = attempts
    for b in ("debug", "generation"):
        for m in ("passed", "acc_pct", "problem_passed", "target_ok"):
            wide = wide.withColumn(f"{b}_{m}", F.col(f"{b}.{m}"))
    none = F.col("debug").isNull() & F.col("generation").isNull()
    winner = F.when(none, "buggy").otherwise(route(policy))
    of = lambda d, g, buggy: F.when(F.col("_winner") == "debug", d).when(F.col("_winner") == "generation", g).otherwise(buggy)
    sample = lambda b: F.concat(F.lit(f"{b}_sample_"), F.col(f"{b}_sample").cast("string"))
    buggy = evaluation(**{m: F.col(f"baseline.{m}") for m in ALL})
    out = apart(wide.withColumn("_winner", winner)).withColumns(
        {
            "nonbacktracking": of(F.col("debug"), F.col("generation"), buggy),
            "selected_source": of(sample("debug"), sample("generation"), F.lit("buggy")),
            "selected_code": of(F.col("debug_code"), F.col("generation_code"), F.col("buggy_code")),
            "verifier_selected": of(F.col("verifier_debug"), F.col("verifier_generation"), F.lit(None)),
        }
    )
    untested = F.coalesce(F.col("verifier_baseline.total"), F.lit(0)) <= 0
    keep = {
        "oracle": backtrack(F.col("nonbacktracking.passed"), F.col("baseline.passed")),
        "generated": ~untested & backtrack(F.col("verifier_selected.passed"), F.col("verifier_baseline.passed")),
    }
    gates = {k: F.when(x, F.col("nonbacktracking")).otherwise(buggy) for k, x in keep.items()}
    gates |= {f"{k}_source": F.when(x, F.col("selected_source")).otherwise("buggy") for k, x in keep.items()}
    lost = F.when(untested & (F.col("selected_source") != "buggy"), "rl_generated_backtracking_missing_or_empty_verifier")
    gates |= {"target_ok": F.col("nonbacktracking.target_ok"), "note": notes(F.col("note"), lost)}
    return apart(out).withColumns(gates).select(*attempts.columns, *[c for c in ("selected_source", "selected_code", "verifier_selected", "nonbacktracking", *gates) if c not in attempts.columns])


def skipped(attempts: DataFrame, reason: Column) -> DataFrame:
    """chosen() with the rows that aren't attempted (a reason that is neither null nor blank) as records: the buggy
    program is every choice, with its own counts and no target; what wasn't run is null, and the note is the reason."""
    skip = F.coalesce(reason, F.lit("")) != ""
    buggy = evaluation(**{m: F.col(f"baseline.{m}") for m in ALL})
    then = {c: buggy for c in CHOICES} | {c: F.lit("buggy") for c in ("selected_source", "oracle_source", "generated_source")}
    then |= {"selected_code": F.col("buggy_code"), "note": reason, "target_ok": F.lit(False)}
    then |= {c: F.lit(None) for c in attempts.columns if c in ("debug", "generation") or c.startswith("verifier_")}
    then |= {c: F.lit(None) for c in ("debug_code", "generation_code", "target_got_selected") if c in attempts.columns}
    then |= {c: F.lit(0) for c in CHARS if c in attempts.columns}
    return apart(attempts).withColumns({c: F.when(skip, x).otherwise(F.col(c)) for c, x in then.items()})


def attempt_rows(attempts: DataFrame, layout: str) -> DataFrame:
    """The log's rows as text: percents with two decimals, flags as 0 and 1, counts of characters 0 where none are
    known, blank for all else that an attempt lacks, and for fields that the table hasn't."""
    there = {f.name: f.dataType for f in attempts.schema}

    def cell(column: str, path: str) -> Column | None:
        field, _, measure = path.partition(".")
        if field not in there:
            return None
        x = F.col(f"`{field}`")[measure] if measure else F.col(f"`{field}`")
        if measure == "problem_passed" or path == "target_ok":
            x = x.cast("int")
        return (F.coalesce(x, F.lit(0)) if path in CHARS else x).alias(column)

    columns = LAYOUTS[layout]
    return log_rows(apart(attempts).select(*[c for c in (cell(*kv) for kv in columns.items()) if c is not None]), list(columns))
