"""What the sandbox runs: a warm interpreter that forks a child for every job.

serve() has imported what jobs need and waits on a socket. A job comes as open files: stdin, stdout and stderr of the
child, the job itself as JSON, and two channels of its own. The child writes its outcome to the first, behind the job's
random token, and ends at once, so that nothing that candidates print or leave to destructors and exit handlers gets
among it; lines that a trace reaches go to the second as they are reached, and are there after a kill.

This file is run by an isolated interpreter, so it uses the standard library only (and numpy, if there is one).
"""

import ast
import atexit
import contextlib
import copy
import gc
import io
import itertools
import json
import os
import re
import random
import resource
import signal
import socket
import sys
import textwrap
import threading
import traceback
import types

# What a suite's code finds imported.
SUITE_IMPORTS = """
import random, functools, collections, string, math, datetime
from typing import *
from functools import *
from collections import *
from itertools import *
from heapq import *
from bisect import *
from string import *
from operator import *
from math import *
from collections import deque
"""
# What a called function's code finds imported; numpy too, if the code names it.
CALL_IMPORTS = """
import math
import re
import sys
import copy
import datetime
import itertools
import collections
import heapq
import functools
import hashlib
import string
from typing import *
from collections import *
from functools import *
"""
NUMPY = "import numpy\nimport numpy as np\n"


class ListNode:
    def __init__(self, val=0, next=None):
        self.val, self.next = val, next


class TreeNode:
    def __init__(self, val=0, left=None, right=None):
        self.val, self.left, self.right = val, left, right


def list_node(values):
    head = None
    for v in reversed(values or []):
        head = ListNode(v, head)
    return head


def is_same_list(p1, p2):
    while p1 and p2 and p1.val == p2.val:
        p1, p2 = p1.next, p2.next
    return not p1 and not p2


def tree_node(values):
    """A tree from its levels, left to right. What follows the first None behind the root has no place in it."""
    if not values:
        return None
    nodes = [TreeNode(values[0]), *map(TreeNode, itertools.takewhile(lambda v: v is not None, values[1:]))]
    for i, node in enumerate(nodes):
        node.left, node.right = [*nodes[2 * i + 1 : 2 * i + 3], None, None][:2]
    return nodes[0]


def is_same_tree(p, q):
    todo = [(p, q)]
    while todo:
        a, b = todo.pop()
        if a and b and a.val == b.val:
            todo += [(a.left, b.left), (a.right, b.right)]
        elif a or b:
            return False
    return True


#: What the imports bind, by their text: serve() runs them once, a child copies the names.
PREPARED = {}


def namespace(imports, code, helpers=False):
    env = {"__name__": "candidate"}
    if imports in PREPARED:
        env |= PREPARED[imports]
    else:
        exec(imports, env)
    if re.search(r"\b(np|numpy)\b", code):
        exec(NUMPY, env)
    if helpers:
        env |= {f.__name__: f for f in (ListNode, TreeNode, list_node, is_same_list, tree_node, is_same_tree)} | {"inf": float("inf")}
    return env


def plain(text):
    """LF line ends, without common indentation and byte order mark."""
    return textwrap.dedent(re.sub("\r\n?", "\n", text or "")).lstrip("﻿")


def entry_of(given, code):
    if (given or "").strip():
        return given.strip()
    if m := re.search(r"class\s+Solution\s*:\s*.*?\n\s*def\s+([A-Za-z_]\w*)\s*\(", code, re.S):
        return f"Solution().{m[1]}"
    m = re.search(r"^\s*def\s+([A-Za-z_]\w*)\s*\(", code, re.M)
    return m[1] if m else "solve"


def told(e):
    return f"{type(e).__name__}: {e}"[:2000]


def tracer(channel):
    """A trace function that writes each line of the candidate's code when it is first reached."""
    seen = set()

    def traced(frame, event, arg):
        if frame.f_code.co_filename == "<candidate>":
            if event == "line" and frame.f_lineno not in seen:
                seen.add(frame.f_lineno)
                os.write(channel, b"%d\n" % frame.f_lineno)
            return traced

    return traced


def loaded(code, env, entry):
    """(what the entry point names, what went wrong with the code)."""
    try:
        exec(compile(code, "<candidate>", "exec"), env)
    except Exception as e:
        return missing, f"candidate_syntax_or_exec: {told(e)}"
    try:
        return eval(entry, env), ""
    except Exception:
        return missing, ""


def missing(*_, **__):
    raise NotImplementedError("entry point is missing or invalid")


@contextlib.contextmanager
def quiet():
    out = io.StringIO()
    with contextlib.redirect_stdout(out), contextlib.redirect_stderr(io.StringIO()):
        yield out


def tried(index, run):
    """The result of one test: run() is true, and raises nothing."""
    ok, kind, message = False, "", ""
    with quiet() as out:
        try:
            ok = bool(run())
        except Exception as e:
            kind, message = type(e).__name__, str(e)[:2000]
    return {"index": index, "ok": ok, "stdout": out.getvalue(), "error_type": kind, "error_msg": message}


def deferred(statement):
    """An assert as a statement that puts its test aside, to be run later."""
    aside = ast.parse("__aside__.append(lambda: 0)").body[0]
    aside.value.args[0].body = statement.test
    return ast.fix_missing_locations(ast.copy_location(aside, statement))


def suite(job):
    """check(candidate) runs once and puts its own asserts aside; each is then run by itself. Asserts that it doesn't
    reach, or that stand deeper, have failed."""
    tests, code = plain(job["tests"]), plain(job["code"])
    try:
        tree = ast.parse(tests)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return {"results": [], "error_type": "tests_parse", "error_msg": told(e), "total": 0}
    total = sum(isinstance(n, ast.Assert) for n in ast.walk(tree))
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef) and node.name == "check":
            kept = [s for s in node.body if job["helpers"] or isinstance(s, ast.Assert)]
            node.body = [deferred(s) if isinstance(s, ast.Assert) else s for s in kept] or [ast.Pass()]
    env = namespace(SUITE_IMPORTS, code + tests, helpers=True) | {"__aside__": []}
    if job["cover"]:
        sys.settrace(tracer(job["trace"]))
    with quiet():
        candidate, wrong = loaded(code, env, entry_of(job["entry"], code))
        try:
            exec(compile(ast.fix_missing_locations(tree), "<tests>", "exec"), env)
        except Exception as e:
            return {"results": [], "error_type": "exec", "error_msg": told(e), "total": total}
        with contextlib.suppress(Exception):
            env["check"](candidate)
    results = [tried(i, test) for i, test in enumerate(env["__aside__"])]
    ok = not wrong and total > 0 and sum(r["ok"] for r in results) == total
    kind = "" if ok else "candidate" if wrong else "no_asserts" if not total else "assert"
    return {"results": results, "error_type": kind, "error_msg": wrong, "total": total}


def close(a, b):
    """|a - b| <= 1e-6 + 1e-7 |b|, member by member; one number is held against every member of a list."""
    if isinstance(a, (list, tuple)) or isinstance(b, (list, tuple)):
        xs, ys = (list(v) if isinstance(v, (list, tuple)) else [v] for v in (a, b))
        n = max(len(xs), len(ys))
        if not {len(xs), len(ys)} <= {1, n}:
            raise ValueError(f"{len(xs)} members, not {len(ys)}")
        return all(close(x, y) for x, y in zip(xs * (n // len(xs) if xs else 1), ys * (n // len(ys) if ys else 1)))
    return a == b or abs(a - b) <= 1e-6 + 1e-7 * abs(b)


def floats(x):
    return isinstance(x, float) or (isinstance(x, list) and all(map(floats, x)))


def same(got, want, as_set):
    if isinstance(got, str) and isinstance(want, str) and "error" in got.lower() and "error" in want.lower():
        return True
    tolerant = floats(want)
    if as_set:
        with contextlib.suppress(TypeError):
            got, want = set(got), set(want)
    equal = got == want
    equal = bool(equal.all()) if hasattr(equal, "all") else bool(equal)
    return equal or (tolerant and not as_set and close(got.tolist() if hasattr(got, "tolist") else got, want))


def late(*_):
    raise TimeoutError("Timed out!")


@contextlib.contextmanager
def limited(seconds):
    signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)


def literal(text):
    with contextlib.suppress(ValueError, SyntaxError, RecursionError, MemoryError):
        found = ast.literal_eval(text or "[]")
        return found if isinstance(found, list) else None


def calls(job):
    """The function is called on each input by itself: '' (as expected), fail, or timeout for whatever raises."""
    inputs, wants, code = literal(job["inputs"]), literal(job["results"]), job["code"] or ""
    result = lambda i, kind, message="", out="": {"index": i, "ok": not kind, "stdout": out, "error_type": kind, "error_msg": message[:2000]}
    if inputs is None or wants is None:
        return {"results": [], "error_type": "tests_parse", "error_msg": "inputs or results are no lists", "total": 0}
    env = namespace(CALL_IMPORTS, code)
    held = int(open("/proc/self/statm").read().split()[0]) * resource.getpagesize() if os.path.exists("/proc/self/statm") else 0
    hard = resource.getrlimit(resource.RLIMIT_AS)[1]
    most = held + job["memory"] if hard == resource.RLIM_INFINITY else min(hard, held + job["memory"])
    resource.setrlimit(resource.RLIMIT_AS, (most, hard))
    n = max(1, len(inputs))
    try:
        with limited(job["call_seconds"]), quiet():
            exec(compile(code, "<candidate>", "exec"), env)
            fn = env[job["entry"]] if job["entry"] else None
    except Exception as e:
        return {"results": [result(i, "timeout", f"Error: {e}") for i in range(n)], "error_type": "candidate", "error_msg": told(e), "total": n}
    if not inputs or fn is None:
        return {"results": [result(0, "")], "error_type": "", "error_msg": "", "total": 1}
    results = []
    for i, args in enumerate(inputs):
        with quiet() as out:
            try:
                with limited(job["call_seconds"]):
                    got = fn(*copy.deepcopy(args))
                equal = same(got, wants[i], job["as_set"])
                kind, message = ("", "") if equal else ("fail", repr(got))
            except Exception as e:
                kind, message = "timeout", f"Error: {e}"
        results.append(result(i, kind, message, out.getvalue()))
    return {"results": results, "error_type": "", "error_msg": "", "total": len(results)}


def pairs_of(tree):
    """The literal lists `inputs` and `results` of a check, the last of each, if they are as long as each other."""
    found = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Assign):
            for target in node.targets:
                if isinstance(target, ast.Name) and target.id in ("inputs", "results"):
                    with contextlib.suppress(ValueError):
                        found[target.id] = ast.literal_eval(node.value)
    inputs, wants = found.get("inputs"), found.get("results")
    if isinstance(inputs, list) and isinstance(wants, list) and len(inputs) == len(wants):
        return list(zip(inputs, wants))


def dataset(job):
    """A data set's own tests: its pairs of inputs and results one by one; without such, check(candidate) as a whole."""
    tests, code = plain(job["tests"]).strip(), plain(job["code"]).strip()
    try:
        pairs = pairs_of(ast.parse(tests))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        pairs = None
    env = namespace(SUITE_IMPORTS, code + tests, helpers=True)
    with quiet():
        candidate, wrong = loaded(code, env, entry_of(job["entry"], code))
        try:
            exec(compile(tests, "<tests>", "exec"), env)
        except Exception as e:
            return {"results": [], "error_type": "exec_error", "error_msg": told(e), "total": 0, "mode": "exec_error"}

    def one(args, want):
        got = candidate(*(args if isinstance(args, (list, tuple)) else [args]))
        if callable(env.get("assertion")):
            env["assertion"](got, want, 0)
            return True
        if not (close(got, want) if isinstance(want, float) else got == want):
            raise AssertionError(repr(got)[:500])
        return True

    def whole():
        env["check"](candidate)
        return True

    if pairs is None:
        results, mode = [tried(0, whole)], "whole_check"
    else:
        results, mode = [tried(i, lambda p=p: one(*p)) for i, p in enumerate(pairs)], "pairs"
    return {"results": results, "error_type": "candidate" if wrong else "", "error_msg": wrong, "total": len(results), "mode": mode}


def literal_text(value):
    """A value as a Python literal, whatever numpy made of it: arrays are lists, its numbers plain ones.

    Raises ValueError for what has no literal. Infinite numbers are 1e999.
    """
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple, set, frozenset)):
        parts = [literal_text(v) for v in value]
        if isinstance(value, (set, frozenset)):
            return "{" + ", ".join(sorted(parts)) + "}" if parts else "set()"
        return f"[{', '.join(parts)}]" if isinstance(value, list) else f"({', '.join(parts)}{',' * (len(parts) == 1)})"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{literal_text(k)}: {literal_text(v)}" for k, v in value.items()) + "}"
    if isinstance(value, float) and value - value != 0:
        if value != value:
            raise ValueError("not a number")
        return "1e999" if value > 0 else "-1e999"
    if value is None or isinstance(value, (bool, int, float, complex, str, bytes)):
        return repr(value)
    raise ValueError(f"no literal: {type(value).__name__}")


def lists(job):
    """inputs and results after the assignments of job["code"], as literals; both lists and as long as each other."""
    env = {}
    failed = lambda kind, message: {"results": [], "error_type": kind, "error_msg": message, "total": 0}
    try:
        with quiet():
            exec("import numpy as np\n" if re.search(r"\bnp\b", job["code"]) else "", env)
            exec(job["code"], env)
            inputs, wants = env.get("inputs"), env.get("results")
            if not isinstance(inputs, list) or not isinstance(wants, list) or len(inputs) != len(wants):
                return failed("lists", "inputs and results are no lists of one length")
            return {"results": [], "lists": [literal_text(inputs), literal_text(wants)], "error_type": "", "error_msg": "", "total": len(inputs)}
    except Exception as e:
        return failed("lists", told(e))


def program(job):
    """A program as the main module, to the end of an interpreter; its return code."""
    main, code = types.ModuleType("__main__"), 0
    sys.modules["__main__"], sys.argv = main, ["candidate.py"]
    try:
        exec(compile(job["code"], "candidate.py", "exec"), main.__dict__)
    except SystemExit as e:
        code = e.code if isinstance(e.code, int) else 0 if e.code is None else 1
        if code and not isinstance(e.code, int):
            print(e.code, file=sys.stderr)
    except BaseException as e:
        traceback.print_exception(type(e), e, e.__traceback__ and e.__traceback__.tb_next)
        code = 1
    with contextlib.suppress(Exception):
        threading._shutdown()
        atexit._run_exitfuncs()
        main.__dict__.clear()
        gc.collect()
    for stream in (sys.stdout, sys.stderr):
        try:
            stream.flush()
        except Exception:
            code = code or 120
    return code & 255


def forked(files, given):
    """The child: limits, files and folder of its own, the job, its outcome."""
    os.setsid()
    os.chdir(given["folder"])
    for i in range(3):
        os.dup2(files[i], i)
        os.close(files[i])
    with open(files[3], encoding="utf-8", errors="surrogatepass") as f:
        job = json.load(f)
    for what, most in ((resource.RLIMIT_CPU, given["cpu"]), (resource.RLIMIT_AS, given["memory"]), (resource.RLIMIT_FSIZE, given["written"]), (resource.RLIMIT_CORE, 0)):
        resource.setrlimit(what, (most, most))
    random.seed()
    kind, token = job.pop("kind"), job.pop("token").encode()
    if kind == "program":
        os.close(files[4])
        os.close(files[5])
        return program(job)
    outcome = {"suite": suite, "calls": calls, "dataset": dataset, "lists": lists}[kind](job | {"trace": files[5]})
    sys.settrace(None)
    data = memoryview(token + json.dumps(outcome).encode())
    while data:
        data = data[os.write(files[4], data) :]
    return 0


def warm():
    """Runs the imports, and a job whose patterns, parser and encoder a child would set up anew each time."""
    with contextlib.suppress(ImportError):
        import numpy  # noqa: F401
    for imports in (SUITE_IMPORTS, CALL_IMPORTS):
        env = {"__name__": "candidate"}
        exec(imports, env)
        PREPARED[imports] = env
    job = {"code": "def f(x):\n    return x", "tests": "def check(candidate):\n    assert candidate(0) == 0", "entry": "", "helpers": True, "cover": False}
    json.loads(json.dumps([suite(job), dataset(job)]))


def serve(sock):
    """Jobs one after the other: the child's process id, and its status when it has ended."""
    warm()
    gc.collect()
    gc.freeze()
    while True:
        data, files, _, _ = socket.recv_fds(sock, 1 << 16, 6)
        if not data:
            return
        pid = os.fork()
        if not pid:
            code = 1
            try:
                sock.close()
                code = forked(files, json.loads(data))
            except BaseException:
                traceback.print_exc()
            finally:
                os._exit(code)
        for f in files:
            os.close(f)
        sock.sendall(b"%d\n" % pid)
        sock.sendall(b"%d\n" % os.waitstatus_to_exitcode(os.waitpid(pid, 0)[1]))


if __name__ == "__main__":
    serve(socket.socket(fileno=int(sys.argv[1])))
