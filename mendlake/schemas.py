"""Schemas of the records that the readers expect."""

from pyspark.sql import types as T

_s = lambda *names: T.StructType([T.StructField(n, T.StringType()) for n in names])

TEST_CASE = T.StructType().add("input", "string").add("output", "string")
RESULT = T.StructType().add("index", "integer").add("ok", "boolean").add("stdout", "string").add("error_type", "string").add("error_msg", "string")
EVAL = T.StructType().add("target_ok", "boolean").add("full_suite_passed", "integer").add("full_suite_total", "integer").add("full_suite_acc_pct", "double").add("problem_passed", "boolean")
MESSAGE = T.StructType().add("role", "string").add("content", "string")
PROBLEM = _s("task_id", "question_id", "query", "prompt", "problem_description", "starter_code", "completion", "entry_point", "test", "test_code", "difficulty")
IO_LIST_ROW = _s("task_id", "prompt", "code", "canonical_solution", "entry_point", "test", "signature")
BUGGY_POOL = _s("task_id", "question_id", "prediction")
BUGGY_REQUIRED = ["task_id", "question_id", "buggy_code", "test_code", "selected_assert_index", "selected_assert_text", "baseline_total", "baseline_failed", "baseline_passed", "entry_point", "query"]
BUG_FARM = T.StructType().add("question_id", "string").add("base_model_tag", "string").add("code_idx", "integer").add("buggy_code", "string").add("buggy_raw_output", "string").add("bug_uid", "string").add("task_id", "string")
VERIFIER = T.StructType([*_s("task_id", "question_id", "source_tsv", "generated_test_code_eval", "generated_test_code_clean", "generated_test_code_raw_extracted"), T.StructField("generated_wellformed", T.BooleanType())])
CANDIDATE = T.StructType().add("row_key", "string").add("benchmark", "string").add("branch", "string").add("sample", "integer").add("raw_text", "string").add("prompt_chars", "integer")
SUMMARY_EVENT = T.StructType([*_s("event", "experiment", "task_id", "question_id", "bug_uid", "selected_source", "note"), *[T.StructField(n, EVAL) for n in ("baseline_eval", "nonbacktracking_eval", "backtracking_with_oracle_tests_eval", "backtracking_with_rl_generated_tests_eval")]])
