"""Secret scans: patterns, and guess costs of values in credential contexts.

Patterns find assignments, access keys and hex strings. Beyond them, values that stand where a credential is named
("password is ...", "pwd: ...", "://user:...@") are weighed by the least number of guesses that would reach them: a
dynamic programme over the value cuts it into common words, dates, repeats, keyboard walks, alphabetic or numeric
sequences and brute-force spans, and adds the logarithms of the guesses of each piece. A value that costs at least
MIN_LOG10 is a secret; "password: changeme1" is none.

Words and their ranks are a dictionary: some passwords in order of use, then the words of a vocabulary file whose ranks
follow how common they are (byte pairs merged by frequency). Its path is a parameter; the driver reads it and sends the
words (some ten thousand) to the tasks.

One pass over whole texts, without any shuffle; a text is handled alone, in memory linear in its length, and in time
linear but for a binary search for each value among the text's spans.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_MIN = 8
#: Runs of at least 16 and 32 characters; a shorter run holds no longer one, so this is the same as dropping them.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Where a credential is named, and its value.
CONTEXTS = (
    re.compile(r"""\b(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|api[_\- ]?key|credentials?|login)\b["'`]?\x20*(?:=>|->|:=|[:=]|\bis\b)\x20*["'`]?([^\s"'`<>]+)""", re.I | re.A),
    re.compile(r"://[^\s:/@]++:([^\s@/]++)@"),
)
MIN_LOG10 = 10.0
MIN_LENGTH = 8
#: Brute force: ten guesses a character; each piece after the first doubles the guesses.
CHARACTER, PIECE = 1.0, math.log10(2)
# Common passwords and parts of passwords, the most common first.
COMMON = tuple(
    """password 123456 qwerty admin welcome letmein monkey dragon login abc123 iloveyou master sunshine princess football
    shadow michael baseball superman trustno1 hunter batman access hello charlie freedom whatever starwars secret test
    changeme default guest root user pass temp example sample demo token apikey system manager server oracle database
    summer winter spring autumn love money computer internet office company january february march april may june july
    august september october november december monday tuesday wednesday thursday friday saturday sunday red blue green
    black white orange yellow purple silver gold tiger lion eagle apple banana cherry coffee cookie killer soccer hockey
    ranger harley jordan thomas robert daniel andrew joshua matthew jessica ashley jennifer amanda george maggie pepper
    ginger buster flower matrix phoenix mustang mercury jaguar letter number strong stronger required invalid correct
    horse battery staple your here none null true false string value enter must the and for not are with this that""".split()
)
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {(b, a) for row in ROWS for a, b in zip(row, row[1:], strict=False)}
DATES = (
    re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])", re.A),
    re.compile(r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d", re.A),
    re.compile(r"(?:19|20)\d\d", re.A),
)
DAY, YEAR = math.log10(365 * 130), math.log10(130)


@dataclass(frozen=True)
class Dictionary:
    """log10 of the guesses that reach each word, and the longest word's length."""

    costs: dict[str, float]
    longest: int

    @staticmethod
    def of(words: Iterator[str] | tuple[str, ...]) -> Dictionary:
        """words: the most common first; one that repeats keeps its first place."""
        costs = {w: math.log10(i + 2) for i, w in enumerate(dict.fromkeys(words))}
        return Dictionary(costs, max(map(len, costs), default=0))


PASSWORDS = Dictionary.of(COMMON)


def dictionary(vocabulary: str | None = None) -> Dictionary:
    """The common passwords, then the lower-case words of three letters or more of a vocabulary file by rank (lines of a
    token in base 64 and its rank)."""
    if vocabulary is None:
        return PASSWORDS
    with open(vocabulary, "rb") as f:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    tokens = (t.decode(errors="replace").strip() for _, t in ranked)
    return Dictionary.of((*COMMON, *(t for t in tokens if len(t) >= 3 and t.isascii() and t.isalpha() and t.islower())))


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LEAST, UNITS = 3, 4  # characters of a word, walk, sequence or repeat; of the longest unit that repeats


class _Starts:
    """The cheapest start i of a span that ends at j, for spans that cost done[i] + log10(j - i).

    The logarithm grows ever slower, so a start that is no dearer than a later one stays so: later starts are on top
    of a stack as long as they are cheaper, each above the one that will overtake it, at a place known beforehand.
    """

    def __init__(self) -> None:
        self._stack: list[tuple[float, int, float]] = []  # (cost, start, from where the one below is no dearer)

    @staticmethod
    def _overtaken(old: tuple, cost: float, start: int) -> float:
        """The least j at which old + log10(j - old start) <= cost + log10(j - start)."""
        by = 10.0 ** min(cost - old[0], 300.0)
        return (by * start - old[1]) / (by - 1) if by > 1 else math.inf

    def add(self, cost: float, start: int, j: int) -> None:
        """A start for ends from j on."""
        stack = self._stack
        self._settle(j)
        if stack and stack[-1][0] + math.log10(j - stack[-1][1]) <= cost + math.log10(j - start):
            return
        while len(stack) > 1 and self._overtaken(stack[-1], cost, start) >= stack[-1][2]:
            stack.pop()  # overtaken itself before it could overtake
        stack.append((cost, start, self._overtaken(stack[-1], cost, start) if stack else math.inf))

    def _settle(self, j: int) -> None:
        while len(self._stack) > 1 and self._stack[-1][2] <= j:
            self._stack.pop()

    def best(self, j: int) -> float:
        self._settle(j)
        return self._stack[-1][0] + math.log10(j - self._stack[-1][1]) if self._stack else math.inf


def guess_cost(value: str, known: Dictionary = PASSWORDS) -> float:
    """log10 of the least guesses over all segmentations of value into known words, dates, repeats of up to UNITS
    characters, walks on the keyboard, sequences and brute-force spans, each anywhere and of any length.

    Walks, sequences and repeats may be cut at any place, so their starts are kept for each end; with them the time is
    about linear in the value's length.
    """
    n, low = len(value), value.translate(LOWER)
    done, brute = [0.0] * (n + 1), math.inf  # least cost of value[:i]; of value[:j] with a brute-force span at its end
    ahead: dict[int, list[tuple[int, float]]] = {}  # words and dates by their ends
    walks, steps, repeats = _Starts(), _Starts(), {}
    walk = step = by = 0  # where the walk and the sequence that reach the last character begin; the sequence's direction
    same = [0] * (UNITS + 1)  # how many characters up to the last one equal those a unit before
    for j in range(1, n + 1):
        i, opened = j - 1, done[j - 1] + (PIECE if j > 1 else 0.0)
        for k in range(i + LEAST, min(n, i + known.longest) + 1):
            if (cost := known.costs.get(low[i:k])) is not None:
                ahead.setdefault(k, []).append((i, cost + (0.0 if value[i:k] == low[i:k] else 0.5)))
        for date in DATES if value[i].isdecimal() else ():
            if m := date.match(value, i):
                ahead.setdefault(m.end(), []).append((i, DAY if m.end() - i > 4 else YEAR))
        brute = min(brute, opened) + CHARACTER
        least = brute
        start = lambda i: done[i] + (PIECE if i else 0.0)
        for i, cost in ahead.pop(j, ()):
            least = min(least, start(i) + cost)
        if j > 1:
            a, b = low[j - 2], low[j - 1]
            if (a, b) not in NEXT:
                walks, walk = _Starts(), j - 1
            turn = ord(b) - ord(a)
            if turn not in (1, -1) or not (a.isalnum() and b.isalnum()):
                steps, step, by = _Starts(), j - 1, 0
            elif turn != by:
                steps, step, by = _Starts(), j - 2, turn
            if j - LEAST >= walk:
                walks.add(start(j - LEAST), j - LEAST, j)
                least = min(least, walks.best(j) + math.log10(47 * 2))
            if by and j - LEAST >= step:
                steps.add(start(j - LEAST), j - LEAST, j)
                least = min(least, steps.best(j) + math.log10(26 * 2))
        for unit in range(1, min(UNITS, j - 1) + 1):
            if value[j - 1] != value[j - 1 - unit]:
                same[unit] = 0
                for r in range(unit):
                    repeats.pop((unit, r), None)
                continue
            same[unit] += 1
            size = unit * max(2, -(-LEAST // unit))  # of the shortest span of whole units
            if same[unit] + unit >= size:
                starts = repeats.setdefault((unit, j % unit), _Starts())
                starts.add(start(j - size), j - size, j)
                least = min(least, starts.best(j) + unit * CHARACTER - math.log10(unit))
        done[j] = least
    return done[n]


def find(text: str, known: Dictionary = PASSWORDS) -> tuple[list[tuple[int, int, str]], float]:
    """Spans (start, end, kind) of a text by start and kind, and the largest cost of a context's value (0: no value)."""
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    # Those that begin at a value or before it hold it if the one that reaches furthest does.
    starts = sorted(s for s, _, _ in spans)
    reach = list(accumulate((e for _, e, _ in sorted(spans)), max))
    most, extra = 0.0, set()
    for pattern in CONTEXTS:
        for m in pattern.finditer(text):
            value = m[1].rstrip(".,;:!?)]}")
            if len(value) >= MIN_LENGTH:
                cost = guess_cost(value, known)
                most = max(most, cost)
                start, end = m.start(1), m.start(1) + len(value)
                before = bisect_right(starts, start)
                if cost >= MIN_LOG10 and not (before and reach[before - 1] >= end):
                    extra.add((start, end, "guess"))
    return sorted([*spans, *extra], key=lambda x: (x[0], KINDS.index(x[2]), x[1])), most


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


OUT = T.StructType().add("n_assign", "long").add("n_access", "long").add("n_hex", "long").add("n_guess", "long").add("base_sha256", "string").add("spans", "string").add("max_log10_guesses", "double")


def _scanner(shared) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for text in part.column(part.num_columns - 1):
                    spans, most = find(text.as_py() or "", known)
                    base = [s for s in spans if s[2] != "guess"]
                    count = [sum(s[2] == k for s in spans) for k in KINDS]
                    rows.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), most))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64()], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *cols], [*part.schema.names[:-1], *OUT.names])

    return scan


def scan(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The columns keep of every row of df, and its secrets.

    n_assign, n_access, n_hex, n_guess; base_sha256 of the pattern spans; spans: kind:start:end in code points, end
    exclusive, by start and kind; max_log10_guesses of the values in contexts. A null or empty text has none. Rows that
    repeat are scanned each; other columns of df are not read; keep may not hold an output's name. vocabulary: a file of
    the driver's, see dictionary().
    """
    shared = df.sparkSession.sparkContext.broadcast(dictionary(vocabulary))
    schema = T.StructType([*[df.schema[c] for c in keep], *OUT])
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(_scanner(shared), schema)
