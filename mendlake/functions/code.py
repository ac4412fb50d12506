"""Python source analysed as syntax trees, in Arrow-batched UDFs of small helpers."""

from __future__ import annotations

import ast
import re
import textwrap
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendlake.functions.records import gold_asserts

# Functions that helper expressions of generated tests may call.
CALLABLE = frozenset({"list_node", "tree_node", "sorted", "tuple", "list", "set", "dict", "len", "sum", "min", "max", "abs", "range"})
# The same for suites that know no linked lists and trees.
PLAIN_CALLABLE = frozenset({"sorted", "tuple", "list", "set", "dict", "len", "sum", "min", "max", "abs", "range", "round"})
PLAIN = (ast.expr_context, ast.operator, ast.unaryop, ast.boolop, ast.cmpop, ast.Expression, ast.Constant, ast.Name, ast.List, ast.Tuple, ast.Set, ast.Dict, ast.UnaryOp, ast.BinOp, ast.BoolOp, ast.Compare, ast.Subscript, ast.Slice)
NOT_PLAIN = (ast.MatMult, ast.BitAnd, ast.BitOr, ast.BitXor, ast.LShift, ast.RShift)


def dedented(x: object) -> str:
    return textwrap.dedent(re.sub("\r\n?", "\n", x)).lstrip("﻿") if isinstance(x, str) else ""


def parsed(x: object) -> ast.Module | None:
    try:
        return ast.parse(dedented(x))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def asserts_of(x: object) -> list[str]:
    """Source of every assert, nested ones too, in the order of the text."""
    tree = parsed(x)
    found = [n for n in ast.walk(tree) if isinstance(n, ast.Assert)] if tree else []
    return [ast.unparse(n) for n in sorted(found, key=lambda n: (n.lineno, n.col_offset))]


def check_asserts(x: object) -> list[str]:
    """Source of the asserts that stand directly in the first function check."""
    tree = parsed(x)
    check = next((n for n in tree.body if isinstance(n, ast.FunctionDef) and n.name == "check"), None) if tree else None
    return [ast.unparse(n) for n in check.body if isinstance(n, ast.Assert)] if check else []


def safe_expression(x: str, called: frozenset[str] = CALLABLE) -> bool:
    """Literals, arithmetic, comparisons, subscripts, and calls of the allowed functions."""
    try:
        todo: list[ast.AST] = [ast.parse(x, mode="eval")]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    while todo:
        node = todo.pop()
        if isinstance(node, ast.Call):
            if not (isinstance(node.func, ast.Name) and node.func.id in called):
                return False
            todo += [*node.args, *(k.value for k in node.keywords)]
        elif not isinstance(node, PLAIN) or isinstance(node, NOT_PLAIN):
            return False
        else:
            todo += ast.iter_child_nodes(node)
    return True


def _only_statement(x: str) -> ast.stmt | None:
    tree = parsed(x)
    return tree.body[0] if tree and len(tree.body) == 1 else None


def _helper(line: str) -> bool:
    node = _only_statement(line)
    return isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and safe_expression(ast.unparse(node.value))


HEADER, ASSERT = re.compile(r"def\s+check\s*\("), re.compile(r"assert\b")


def recovered(text: object) -> tuple[list[str], list[str], list[str]]:
    """(helpers, asserts, dropped lines) of test code that may not parse: each assert takes lines until it parses."""
    keep: dict[str, dict[str, None]] = {"helper": {}, "assert": {}}
    dropped, lines, i = [], [line.strip() for line in dedented(text).split("\n")], 0
    while i < len(lines):
        line, i = lines[i], i + 1
        if not line or line.startswith(("#", "```")) or HEADER.match(line):
            continue
        if ASSERT.match(line):
            block, end = line, i
            while not isinstance(_only_statement(block), ast.Assert):
                more = lines[end] if end < len(lines) else None
                if more is None or more.startswith("```") or ((ASSERT.match(more) or HEADER.match(more)) and balance(block) <= 0):
                    dropped.append(block)
                    block = ""
                    break
                block, end = f"{block}\n{more}", end + 1
            i = end
            if block:
                keep["assert"][block] = None
        elif _helper(line):
            keep["helper"][line] = None
        elif "  #" in line and _helper(line.split("  #")[0].rstrip()):
            keep["helper"][line.split("  #")[0].rstrip()] = None
        else:
            dropped.append(line)
    return list(keep["helper"]), list(keep["assert"]), dropped


def balance(text: str) -> int:
    """Opened less closed brackets outside string literals."""
    bare = re.sub(r"""'(?:\\.|[^'\\])*(?:'|$)|"(?:\\.|[^"\\])*(?:"|$)""", "", text, flags=re.S)
    return sum(bare.count(c) for c in "([{") - sum(bare.count(c) for c in ")]}")


FENCED = re.compile(r"```(?:python)?\s*(.*?)\s*```", re.S | re.I)
CHECK_HEADER = re.compile(r"def\s+check\s*\(\s*candidate\s*\)\s*:")


def unfenced(text: object) -> str:
    """The last fenced block; without a closed one, the text less an opening fence."""
    x = re.sub("\r\n?", "\n", text).strip() if isinstance(text, str) else ""
    blocks = FENCED.findall(x)
    if blocks:
        x = blocks[-1]
    elif x.startswith("```"):
        lines = x.split("\n")[1:]
        x = "\n".join(lines[:-1] if lines and lines[-1].strip() == "```" else lines)
    return dedented(x).strip()


class Source:
    """A parsed text, and the texts of its statements."""

    def __init__(self, text: str):
        self.tree = ast.parse(text)
        self._lines = [line.encode() for line in text.split("\n")]

    def text_of(self, node: ast.stmt) -> str:
        """From the first to the last byte of a statement, whose columns count bytes."""
        lines = self._lines[node.lineno - 1 : node.end_lineno]
        lines[-1] = lines[-1][: node.end_col_offset]
        lines[0] = lines[0][node.col_offset :]
        return b"\n".join(lines).decode().strip()

    def check(self) -> ast.FunctionDef | None:
        return next((n for n in self.tree.body if isinstance(n, ast.FunctionDef) and n.name == "check"), None)


def source_of(text: str) -> Source | None:
    try:
        return Source(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _about_candidate(node: ast.AST) -> bool:
    return any(isinstance(n, ast.Name) and n.id == "candidate" for n in ast.walk(node))


def _check_body(text: str) -> list[str]:
    """The lines that are indented below check's header, comments and blank ones too; all lines without a header."""
    lines = text.split("\n")
    start = next((i for i, line in enumerate(lines) if CHECK_HEADER.fullmatch(line.strip())), None)
    if start is None:
        return lines
    deep = lambda line: len(line) - len(line.lstrip(" "))
    body = []
    for line in lines[start + 1 :]:
        if line.strip() and deep(line) <= deep(lines[start]) and not line.lstrip().startswith("#"):
            break
        body.append(line)
    return body


def _scanned(lines: list[str]) -> tuple[list[str], list[str]]:
    """(asserts about the candidate, dropped lines): each assert takes lines until it parses, or until another begins
    or a fence comes where no bracket is open."""
    asserts, dropped, i = [], [], 0
    lines = [line.strip() for line in lines]
    while i < len(lines):
        block, i = lines[i], i + 1
        if not block or block.startswith(("#", "```")):
            continue
        if not ASSERT.match(block):
            dropped.append(block)
            continue
        while not isinstance(node := _only_statement(block), ast.Assert):
            more = lines[i] if i < len(lines) else None
            if more is None or more.startswith("```") or (ASSERT.match(more) and balance(block) <= 0):
                break
            block, i = f"{block}\n{more}", i + 1
        good = isinstance(node, ast.Assert) and _about_candidate(node)
        (asserts if good else dropped).append(block)
    return asserts, dropped


def from_check(text: object) -> tuple[list[str], list[str]]:
    """(asserts about the candidate, dropped texts) of a suite: check's own statements if the text parses and has such
    asserts; else what its lines show, as of a text that was cut off."""
    x, gone = unfenced(text), []
    source = source_of(x)
    if source and (check := source.check()):
        kept = [n for n in check.body if isinstance(n, ast.Assert) and _about_candidate(n)]
        gone = [source.text_of(n) for n in check.body if n not in kept]
        if kept:
            return list(dict.fromkeys(map(source.text_of, kept))), gone
    asserts, dropped = _scanned(_check_body(x))
    return list(dict.fromkeys(asserts)), gone + dropped


def suite(helpers: list[str], asserts: list[str]) -> str:
    body = [*helpers, *asserts] or ["pass"]
    return "\n".join(["def check(candidate):", *(textwrap.indent(b, "    ") for b in body)])


def rebuilt(asserts: Column, ok: Column) -> Column:
    """A suite of the asserts about the candidate that the gold program passes, each once."""
    kept = gold_asserts(asserts, ok)
    lines = F.flatten(F.transform(kept, lambda a: F.transform(F.split(a, "\n"), lambda y: F.concat(F.lit("    "), y))))
    return F.concat(F.lit("def check(candidate):\n"), F.when(F.size(kept) == 0, "    pass").otherwise(F.array_join(lines, "\n")))


TEXTS = T.ArrayType(T.StringType())
SALVAGED = T.StructType().add("code", T.StringType()).add("helpers", TEXTS).add("asserts", TEXTS).add("n_dropped", T.IntegerType()).add("parse_ok", T.BooleanType()).add("mode", T.StringType())
DISTANCE = T.StructType().add("distance", T.DoubleType()).add("normalised", T.DoubleType())
ASSIGNED = T.StructType().add("inputs", T.StringType()).add("results", T.StringType()).add("use_set", T.BooleanType()).add("assignments", T.StringType())
IO_LISTS = T.StructType().add("inputs", T.StringType()).add("results", T.StringType()).add("use_set", T.BooleanType())


@F.pandas_udf(T.IntegerType())
def count_asserts(x: pd.Series) -> pd.Series:
    return x.map(lambda v: len(asserts_of(v))).astype("int32")


@F.pandas_udf(TEXTS)
def assert_texts(x: pd.Series) -> pd.Series:
    return x.map(asserts_of)


@F.pandas_udf(TEXTS)
def check_assert_texts(x: pd.Series) -> pd.Series:
    return x.map(check_asserts)


@F.pandas_udf(T.BooleanType())
def is_safe(x: pd.Series) -> pd.Series:
    return x.map(lambda v: isinstance(v, str) and safe_expression(v))


@F.pandas_udf(T.BooleanType())
def is_plainly_safe(x: pd.Series) -> pd.Series:
    return x.map(lambda v: isinstance(v, str) and safe_expression(v, PLAIN_CALLABLE))


@F.pandas_udf(SALVAGED)
def salvage_checks(extracted: pd.Series, raw: pd.Series) -> pd.DataFrame:
    """One suite of the asserts about the candidate in check, from the tree where a text parses, else from its lines;
    those of the extracted block first, then those of the raw text. It has no helpers."""
    rows = []
    for a, b in zip(extracted, raw, strict=True):
        one, two = from_check(a), from_check(b)
        asserts = list(dict.fromkeys([*one[0], *two[0]]))
        code = suite([], asserts)
        rows.append((code, [], asserts, len(one[1]) + len(two[1]), parsed(code) is not None, "check_ast_or_check_body_only"))
    return pd.DataFrame(rows, columns=["code", "helpers", "asserts", "n_dropped", "parse_ok", "mode"])


@F.pandas_udf(SALVAGED)
def salvage(extracted: pd.Series, raw: pd.Series) -> pd.DataFrame:
    """One suite of what can be recovered from the extracted block and then from the raw text."""
    rows = []
    for a, b in zip(extracted, raw, strict=True):
        one, two = recovered(a), recovered(b)
        helpers, asserts = (list(dict.fromkeys([*one[k], *two[k]])) for k in (0, 1))
        code = suite(helpers, asserts)
        ok = parsed(code) is not None
        whole = ok and isinstance(a, str) and bool(re.search(r"(?m)^\s*def\s+check\s*\(\s*candidate\s*\)\s*:", a))
        rows.append((code, helpers, asserts, len(one[2]) + len(two[2]), ok, "full_parse" if whole else "structured_salvage"))
    return pd.DataFrame(rows, columns=["code", "helpers", "asserts", "n_dropped", "parse_ok", "mode"])


def node_types(x: object) -> list[str] | None:
    """Node types of a program in preorder: a node, then its children from left to right. None if it doesn't parse."""
    try:
        todo: list[ast.AST] = [ast.parse(x if isinstance(x, str) else "")]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out = []
    while todo:
        node = todo.pop()
        out.append(type(node).__name__)
        todo += reversed(list(ast.iter_child_nodes(node)))
    return out


def edit_distance(a: list, b: list) -> int:
    """Edit distance of two sequences, a column of the table at once: bits say where it rises and falls (Hyyrö 2003)."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    every, top, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = every, 0
    for y in b:
        match = at.get(y, 0) | down
        same = (((match & up) + up) ^ up) | match
        right, left = down | ~(same | up), up & same
        distance += bool(right & top) - bool(left & top)
        right = right << 1 | 1
        up, down = (left << 1 | ~(same | right)) & every, right & same & every
    return distance


def _each_once(f: Callable, values: Iterable) -> list:
    """f of each value; equal values of a batch share a call."""
    known: dict = {}
    return [known[v] if v in known else known.setdefault(v, f(v)) for v in values]


@F.pandas_udf(DISTANCE)
def tree_distance(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Edit distance of the sequences of node types, and its share of the first; null (so means skip it) for code that doesn't parse."""
    def one(pair: tuple) -> tuple[float, float]:
        x, y = map(node_types, pair)
        d = float("nan") if x is None or y is None else float(edit_distance(x, y))
        return d, d / max(1, len(x or ()))

    rows = _each_once(one, zip(a, b, strict=True))
    return pd.DataFrame(rows, columns=["distance", "normalised"])


def _literal_lists(text: object) -> tuple[str | None, str | None, bool]:
    found: dict[str, str] = {}
    for node in ast.walk(parsed(text) or ast.Module([], [])):
        if isinstance(node, ast.Assign) and isinstance(node.targets[0], ast.Name) and node.targets[0].id in ("inputs", "results"):
            try:
                found[node.targets[0].id] = repr(ast.literal_eval(node.value))
            except ValueError:
                continue
    return found.get("inputs"), found.get("results"), isinstance(text, str) and " set(" in text


@F.pandas_udf(IO_LISTS)
def io_lists(x: pd.Series) -> pd.DataFrame:
    """The literal lists `inputs` and `results` of a check (the last assignment of each wins), as text."""
    rows = _each_once(_literal_lists, x)
    return pd.DataFrame(rows, columns=["inputs", "results", "use_set"])


def assigned(text: object) -> tuple[str | None, str | None, bool, str | None]:
    """(inputs, results, use_set, assignments) of a check: the lists as literal text if its own assignments to the two
    names are literals, else the assignments, to be evaluated. Nothing without two lists of one length."""
    x = re.sub("\r\n?", "\n", text) if isinstance(text, str) else ""
    use_set, source = " set(" in x, source_of(x)
    check = source.check() if source else None
    own = [n for n in (check.body if check else []) if isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name) and n.targets[0].id in ("inputs", "results")]
    if not own:
        return None, None, use_set, None
    found: dict[str, object] = {}
    for node in own:
        try:
            found[node.targets[0].id] = ast.literal_eval(node.value)
        except (ValueError, TypeError, RecursionError, MemoryError):
            return None, None, use_set, "\n".join(map(source.text_of, own))
    a, b = found.get("inputs"), found.get("results")
    good = isinstance(a, list) and isinstance(b, list) and len(a) == len(b)
    return (repr(a), repr(b), use_set, None) if good else (None, None, use_set, None)


@F.pandas_udf(ASSIGNED)
def assigned_lists(x: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([assigned(v) for v in x], columns=ASSIGNED.names)


@F.pandas_udf(T.StringType())
def python_repr(x: pd.Series) -> pd.Series:
    """A text as Python writes it in a program; null is None."""
    return pd.Series([repr(v) if isinstance(v, str) else "None" for v in x], dtype=object)
