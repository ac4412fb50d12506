"""Text to text, as Column functions: fences, reasoning blocks, markers, clipping, normalising.

White space is ASCII (space and \\t\\n\\x0B\\f\\r) throughout, in Spark as in the SQL that tests compare with.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\n\x0B\f\r]"
FENCE_PY = r"(?i)```python[ \t\n\x0B\f\r]*([\s\S]*?)[ \t\n\x0B\f\r]*```"
FENCE_PY_SHORT = r"(?i)```(?:python|py)[ \t\n\x0B\f\r]*([\s\S]*?)```"
FENCE_ANY = r"```[a-zA-Z0-9_+\-]*[ \t\x0B\f\r]*\n([\s\S]*?)\n```"
FENCE_OPEN = r"(?i)```(?:python|py)?[ \t\x0B\f\r]*\n"
THINK = r"(?is)<think>.*?</think>"
# Where a final answer begins, in order of preference, and how Python lines begin.
MARKERS = (r"4\)\s*FINAL\s+FIX\s*:?", r"FINAL\s+FIX\s*:?", r"FINAL\s+CODE\s*:?", r"CORRECTED\s+CODE\s*:?", r"###\s*Answer\s*:?", r"###\s*Final\s+Answer\s*:?")
# The longest parts of a failing test that prompts hold.
TARGET_CHARS = {"input": 2500, "expected": 2500, "got": 6000, "stderr": 4000}
STARTERS = ("import ", "from ", "def ", "class ", "if __name__", "sys.", "input", "t = ", "n = ", "for ", "while ")


BLANKS = " \t\n\x0b\f\r"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def rstrip(x: Column) -> Column:
    return F.rtrim(x, F.lit(BLANKS))


def newlines(x: Column) -> Column:
    """LF line ends, without a byte order mark; null is empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "\r\n?", "\n"), "^﻿+", "")


def falsy(*columns: Column) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def stdout(x: Column) -> Column:
    """Outputs compare without line-end white space and blank ends."""
    return strip(F.regexp_replace(newlines(x), r"[ \t]+(?=\n)", ""))


def last_match(x: Column, pattern: str, group: int = 1) -> Column:
    """Null without a match."""
    return F.try_element_at(F.regexp_extract_all(x, F.lit(pattern), group), F.lit(-1))


def python_fence(x: Column) -> Column:
    """The last fenced Python block, '' without one."""
    return F.coalesce(strip(last_match(x, FENCE_PY)), F.lit(""))


def dedented(x: Column) -> Column:
    """Without the white space that all lines that aren't blank begin with; such lines become empty."""
    lines = F.split(x, "\n")
    indents = F.transform(F.filter(lines, lambda y: y.rlike(r"[^ \t]")), lambda y: F.regexp_extract(y, r"^[ \t]*", 0))
    low, high = F.array_min(indents), F.array_max(indents)
    # Two texts share what their least and greatest share.
    same = F.filter(F.sequence(F.lit(0), F.least(F.length(low), F.length(high))), lambda n: F.substring(low, F.lit(1), n) == F.substring(high, F.lit(1), n))
    cut = F.coalesce(F.array_max(same), F.lit(0))
    return F.array_join(F.transform(lines, lambda y: F.when(y.rlike(r"[^ \t]"), F.substring(y, cut + 1, F.length(y))).otherwise(F.lit(""))), "\n")


def plain_block(x: Column) -> Column:
    """The last fence of Python or of no language; else the text without a fence line at its ends; dedented, stripped."""
    y = strip(F.coalesce(x, F.lit("")))
    closed = last_match(y, r"(?i)```(?:python)?[ \t\n\x0B\f\r]*([\s\S]*?)```")
    opened = F.regexp_replace(F.regexp_replace(y, r"^```[^\n]*\n?", ""), r"(^|\n)[ \t]*```[ \t]*$", "")
    return strip(dedented(F.coalesce(closed, F.when(y.startswith("```"), opened), y)))


def unfenced(x: Column) -> Column:
    """The inside of one fence, else the text without stray fence marks."""
    inner = F.regexp_extract(x, r"```[a-zA-Z0-9_+\-]*[ \t]*\n?([\s\S]*?)```", 1)
    bare = F.regexp_replace(F.regexp_replace(strip(x), r"^```[a-zA-Z0-9_+\-]*[ \t]*\n?", ""), r"\n?```$", "")
    return strip(F.coalesce(F.nullif(inner, F.lit("")), bare))


def generated_code(x: Column, plain_text: bool = False) -> Column:
    """A Python fence, else any fence; with plain_text the text itself as the last resort."""
    return falsy(python_fence(x), unfenced(x), *([x] if plain_text else []))


def without_thinking(x: Column) -> Column:
    return strip(F.regexp_replace(x, THINK, ""))


def without_echo(x: Column, prompt: Column) -> Column:
    """Without the prompt that a completion repeats at its start."""
    return F.when((F.length(prompt) > 0) & x.startswith(prompt), x.substr(F.length(prompt) + 1, F.length(x))).otherwise(x)


def after_last(x: Column, pattern: str) -> Column:
    """What follows the last match; null without one."""
    parts = F.split(x, pattern)
    return F.when(F.size(parts) > 1, F.element_at(parts, -1))


def final_code(x: Column) -> Column:
    """Code of a long answer: after reasoning and answer markers, the last closed fence, else an unclosed one, else
    those of the whole answer, else from the first line that looks like Python, else everything."""
    t = without_thinking(strip(F.coalesce(x, F.lit(""))))
    t = strip(F.coalesce(after_last(t, "(?i)</think>"), t))
    marked = F.coalesce(*[strip(after_last(t, "(?is)" + m)) for m in MARKERS], t)

    def fenced(y: Column) -> list[Column]:
        closed = [strip(last_match(y, p)) for p in (FENCE_PY_SHORT, FENCE_ANY)]
        return [*closed, strip(F.regexp_replace(strip(after_last(y, FENCE_OPEN)), "`+$", ""))]

    starts = "|".join(s.replace(".", r"\.") for s in STARTERS)
    code = F.nullif(F.regexp_extract(marked, rf"(?m)^[ \t]*(?:{starts})[\s\S]*", 0), F.lit(""))
    return F.coalesce(*fenced(marked), *fenced(t), strip(code), marked)


def looks_like_code(x: Column) -> Column:
    return x.rlike(r"(?m)^\s*(class\s+\w+\s*[:(]|def\s+\w+\s*\()")


def looks_like_check(x: Column) -> Column:
    return x.rlike(r"(?m)^\s*def\s+check\s*\(\s*candidate\s*\)\s*:")


def entry_point(given: Column, code: Column, classes: bool = True) -> Column:
    """The given entry point, else Solution's first method, else the first function, else 'solve'."""
    method = F.regexp_extract(code, r"(?s)class\s+Solution\s*:\s*.*?\n\s*def\s+([A-Za-z_]\w*)\s*\(", 1)
    plain = F.regexp_extract(code, r"(?m)^\s*def\s+([A-Za-z_]\w*)\s*\(", 1)
    found = [F.when(method != "", F.concat(F.lit("Solution()."), method))] if classes else []
    return F.coalesce(F.nullif(strip(given), F.lit("")), *found, F.nullif(plain, F.lit("")), F.lit("solve"))


def clip_middle(x: Column, most: int, label: str = "text") -> Column:
    """At most `most` characters of the beginning and the end, with a note of what is left out between them."""
    x = F.coalesce(x, F.lit(""))
    head, tail = most // 2, most - most // 2
    note = F.concat(F.lit(f"\n\n[... {label} truncated: "), F.length(x).cast("string"), F.lit(f" chars total, kept {head}+{tail} chars ...]\n\n"))
    return F.when(F.lit(most <= 0) | (F.length(x) <= most), x).otherwise(F.concat(F.substring(x, 1, head), note, F.right(x, F.lit(tail))))


def truncated(x: Column, most: int = 6000, suffix: str = "\n# ... truncated ...") -> Column:
    return F.when(F.length(x) > most, F.concat(rstrip(F.substring(x, 1, most)), F.lit(suffix))).otherwise(x)


def as_block(x: Column, pad: str = "    ") -> Column:
    """Lines indented by pad, unless some line that isn't blank already is."""
    lines = F.split(x, "\n")
    indented = F.exists(lines, lambda y: y.rlike(r"^[ \t]+\S"))
    return F.when(indented, x).otherwise(F.array_join(F.transform(lines, lambda y: F.when(F.trim(y) == "", y).otherwise(F.concat(F.lit(pad), y))), "\n"))


def program(prompt: Column, body: Column) -> Column:
    """A whole program: body if it defines something, else prompt with body as its block."""
    return F.when(body.rlike(r"(?m)^(def|class|import|from)\b"), body).otherwise(F.concat(rstrip(prompt), F.lit("\n"), as_block(body)))


def distance(a: Column, b: Column) -> Column:
    """(Levenshtein distance, its share of the longer text; 0 of two empty ones)."""
    d = F.levenshtein(a, b)
    return F.struct(d.alias("distance"), (d / F.greatest(F.length(a), F.length(b), F.lit(1))).alias("normalised"))


def basename(x: Column) -> Column:
    return F.regexp_extract(x, "[^/]+$", 0)


def notes(*parts: Column) -> Column:
    return F.concat_ws(";", *[F.nullif(p, F.lit("")) for p in parts])


def both_errors(a: Column, b: Column) -> Column:
    """Two outputs that both speak of an error count as equal."""
    return (a == b) | (F.lower(a).contains("error") & F.lower(b).contains("error"))
