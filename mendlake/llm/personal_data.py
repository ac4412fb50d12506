"""Personal data: patterns, and spans found by weak supervision.

Patterns find mail addresses, IP addresses, card and phone numbers; they always stay. Beyond them, looser patterns offer
candidates (local phone numbers, written-out addresses, account and identity numbers, dates, names, postal addresses)
and five labelers vote on every candidate, the patterns' finds included: for it, against it, or not at all.

    shape     its own characters: checksums, calendar days, number ranges
    listed    gazetteers: given names, top-level domains, dialling codes, kinds of street
    cue       words before it that announce such data
    foil      words before it that announce something else: versions, orders, prices
    edges     whether it stands inside a longer token

How often each labeler votes which way on true and on other candidates is estimated by expectation-maximisation, for each
kind, from the counts of all votes in the table (kinds times 3^5 at most), with prior counts that say no more than that
labelers are better than chance. The posterior of a candidate's votes is the label that a logistic regression on its
votes, form and neighbouring words learns; the regression decides. It is fitted in one task on at most SAMPLE distinct
candidates; the rest of the work is one pass over whole texts, and one over the candidates found.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendlake.llm.store import materialise

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "local_phone", "written_email", "account", "identity", "birth_date", "name", "address")
LABELERS = ("shape", "listed", "cue", "foil", "edges")
SAMPLE = 20_000
BITS, ROUNDS, STEPS, RATE, L2, CUT = 16, 60, 150, 0.5, 1e-3, 0.5
#: Prior counts of votes (against, none, for) of a labeler on other and on true candidates, and of true candidates.
PRIOR = np.array([[10.0, 8.0, 2.0], [2.0, 8.0, 10.0]])
PRIOR_TRUE = {True: (6.0, 4.0), False: (3.0, 7.0)}  # (true, other), for the patterns' kinds and the rest

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A run of digits with what makes it an address; a run is always consumed, so that long ones are read once.
IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?+")
CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

GIVEN = frozenset(
    """james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth
    barbara susan jessica sarah karen daniel matthew anthony mark paul steven andrew kenneth joshua kevin nancy lisa
    betty margaret sandra ashley emily donna michelle carol hans peter klaus jürgen wolfgang dieter stefan andreas
    ursula monika petra sabine renate karin anna julia lukas jean pierre michel philippe alain bernard marie nathalie
    isabelle sylvie catherine camille antonio josé manuel francisco juan carlos javier miguel carmen josefa isabel
    dolores pilar maría lucía sofía wei ming yuki hiroshi priya rahul fatima omar ahmed mohammed olga ivan""".split()
)
DOMAINS = frozenset("com org net edu gov io info biz de fr es it uk us ca au at ch nl be pl se no dk fi pt br mx in jp cn eu".split())
CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 354 358 420 421".split())
STREETS = frozenset("street st road rd avenue ave lane drive boulevard straße strasse weg platz rue calle avenida plaza".split())
TITLES = frozenset("mr mrs ms dr prof herr frau monsieur madame señor señora".split())

_CUES = {
    "email": "e-?mail|mail|contact|write|reach|correo", "ip": "ip|address|host|login|from|client", "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|cell|fax|contact|telefon|téléphone|teléfono", "account": "iban|account|konto|compte|cuenta|bank",
    "identity": "ssn|social security|identity|national id|passport|tax id", "birth_date": "born|birth|dob|geboren|née?|nacid[oa]|birthday",
    "name": "name|named|dear|regards|contact|sincerely|signed|mr|mrs|ms|dr|prof|herr|frau|monsieur|madame|señora?",
    "address": "address|lives?|resid\\w{2,8}|street|ship|deliver\\w{0,4}|wohnt|anschrift|adresse|domicilio",
}
_CUES |= {"local_phone": _CUES["phone"], "written_email": _CUES["email"]}
CUES = {k: re.compile(rf"\b(?:{v})\b", re.I) for k, v in _CUES.items()}
FOILS = re.compile(r"\b(?:version|releas\w{1,3}|build|model|order|invoice|isbn|sku|part|serial|section|chapter|page|figure|table|price|ticket|issue|commit|copyright|published|updated|company|inc|ltd|university|city)\b", re.I)
BEFORE, AFTER = 40, 16

_CAPITAL = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{1,30}"
PATTERNS = {
    "local_phone": re.compile(r"\([2-9][0-9]{2}\)\x20?[0-9]{3}[-.\x20][0-9]{4}|[2-9][0-9]{2}([-.\x20])[0-9]{3}\1[0-9]{4}|0[0-9]{2,4}[/\x20-][0-9]{5,8}"),
    "account": re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"),
    "identity": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "birth_date": re.compile(r"(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\1(?:19|20)[0-9]{2}"),
    "name": re.compile(rf"{_CAPITAL}(?:\x20{_CAPITAL}){{1,2}}"),
    "address": re.compile(rf"[0-9]{{1,5}}\x20(?:{_CAPITAL}\x20){{1,2}}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Drive|Boulevard)\b|{_CAPITAL[:-6]}{{1,20}}(?:straße|strasse|weg|platz)\x20[0-9]{{1,4}}|[0-9]{{1,4}},?\x20(?:rue|boulevard)\x20(?:de\x20|du\x20|la\x20)?{_CAPITAL}|(?:Calle|Avenida|Plaza)\x20{_CAPITAL},?\x20[0-9]{{1,4}}"),
}
AT = re.compile(r"\x20?[\[(]\x20?at\x20?[\])]\x20?", re.I)
DOTTED = re.compile(r"[A-Za-z0-9-]{1,63}(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?[A-Za-z0-9-]{1,63})+", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(x: str) -> str:
    return "".join(c for c in x if c in "0123456789")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' finds, by kind and start."""
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if m[1] and all(len(p.lstrip("0")) <= 3 and int(p[-20:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _loose(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of the other candidates."""
    for name, pattern in PATTERNS.items():
        kind = KINDS.index(name)
        for m in pattern.finditer(text):
            start = m.start()
            if name == "name":
                while (first := text[start : m.end()].partition("\x20")[0].lower()) not in TITLES and CUES["name"].fullmatch(first):
                    start += len(first) + 1  # "Dear" is no part of a name
                if start >= m.end() or not (first in GIVEN or first in TITLES or CUES["name"].search(text, max(0, start - BEFORE), start)):
                    continue
            yield kind, start, m.end()
    for m in AT.finditer(text) if "at" in text or "AT" in text else ():
        start = m.start()
        while start > max(0, m.start() - 64) and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start() and (d := DOTTED.match(text, m.end())):
            yield KINDS.index("written_email"), start, d.end()


def _day(x: str) -> bool:
    parts = [int(p) for p in re.split("[-./]", x)]
    if parts[0] < 1000:
        parts.reverse()
    for month, day in {(parts[1], parts[2]), (parts[2], parts[1])} if x[4:5] != "-" else {(parts[1], parts[2])}:
        try:
            if datetime.date(parts[0], month, day) < datetime.date(2020, 1, 1):
                return True
        except ValueError:
            pass
    return False


def _iban(x: str) -> bool:
    x = x.replace("\x20", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def _shape(kind: str, x: str) -> int:
    d = _digits(x)
    good = {
        "email": lambda: ".." not in x and not x.startswith((".", "-")), "ip": lambda: x.split(".")[0] not in ("0", "127", "255") and all(p == str(int(p[-9:])) for p in x.split(".")),
        "card": lambda: d[0] in "3456" and len(set(d)) > 2, "phone": lambda: d[0] != "0" and len(set(d)) > 2, "local_phone": lambda: d[3:6] != "000" and len(set(d)) > 2,
        "written_email": lambda: True, "account": lambda: _iban(x), "identity": lambda: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000",
        "birth_date": lambda: _day(x), "name": lambda: len(x) <= 40, "address": lambda: True,
    }[kind]()
    return -1 if not good else int(kind in (*BASE, "account", "identity"))  # a date or a local number proves nothing by being one


def _listed(kind: str, x: str) -> int:
    words = [w.strip(".,()[]").lower() for w in re.split(r"[\x20.]", x)]
    if kind in ("email", "written_email"):
        return 1 if words[-1] in DOMAINS else -1
    if kind == "phone":
        d = _digits(x)
        return 1 if any(d[:n] in CODES for n in (1, 2, 3)) else -1
    if kind == "name":
        return 1 if words[0] in GIVEN or (words[0] in TITLES and len(words) > 1) else 0
    if kind == "address":
        return 1 if any(w in STREETS for w in words) or re.search("straße|strasse|weg|platz", x) else 0
    return 0


def votes_of(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """The five labelers' votes: 1, 0 or -1 each."""
    x, low = text[start:end], max(0, start - BEFORE)
    outer = text[start - 1 : start] + text[end : end + 1]
    inside = any(c.isalnum() or c in "_/@#" for c in outer)
    before = text[low:start]
    cue = bool(CUES[kind].search(before)) or (kind == "name" and x.partition("\x20")[0].lower() in TITLES)
    return _shape(kind, x), _listed(kind, x), int(cue), -int(bool(FOILS.search(before))), -int(inside)


def code_of(votes: tuple[int, ...]) -> int:
    code = 0
    for v in votes:
        code = 3 * code + v + 1
    return code


def votes_from(code: np.ndarray) -> np.ndarray:
    """(n, labelers) of 0 (against), 1 (none), 2 (for)."""
    return np.stack([code // 3 ** (len(LABELERS) - 1 - j) % 3 for j in range(len(LABELERS))], axis=-1)


def _form(x: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[0-9]", "0", re.sub(r"[^\W\d_]", "a", x)))[:12]


def features(text: str, kind: str, start: int, end: int, votes: tuple[int, ...]) -> list[int]:
    """Places in 2^BITS of the votes, alone and with the kind, and of form and neighbouring words with the kind."""
    before = re.findall(r"\w+", text[max(0, start - BEFORE) : start].lower())[-2:]
    after = re.findall(r"\w+", text[end : end + AFTER].lower())[:1]
    named = [f"{n}={v}" for n, v in zip(LABELERS, votes, strict=True)]
    own = [f"form={_form(text[start:end])}", f"size={min(8, (end - start) // 4)}", *(f"before={w[:20]}" for w in before), *(f"after={w[:20]}" for w in after), "kind"]
    return sorted({zlib.crc32(x.encode()) >> (32 - BITS) for x in named + [f"{kind}:{x}" for x in named + own]})


# --- expectation-maximisation over counts of votes


@dataclass
class Reliability:
    """Of each kind: P(true) and P(vote | other, true) of each labeler."""

    true: np.ndarray  # (kinds,)
    vote: np.ndarray  # (kinds, labelers, 2, 3)

    def posterior(self, kind: np.ndarray, code: np.ndarray) -> np.ndarray:
        v = votes_from(code)
        at = (kind[:, None], np.arange(len(LABELERS))[None, :])
        log = [np.log(self.vote[(*at, np.full_like(v, y), v)]).sum(axis=1) + np.log(np.where(y, self.true, 1 - self.true))[kind] for y in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def estimate(kind: np.ndarray, code: np.ndarray, count: np.ndarray) -> Reliability:
    """Expectation-maximisation from the labelers' priors; kind, code of votes and how often each pair was seen."""
    n = len(KINDS)
    prior_true = np.array([PRIOR_TRUE[k in BASE] for k in KINDS])
    r = Reliability(prior_true[:, 0] / prior_true.sum(axis=1), np.broadcast_to(PRIOR / PRIOR.sum(axis=1, keepdims=True), (n, len(LABELERS), 2, 3)).copy())
    v = votes_from(code)
    for _ in range(ROUNDS):
        p = r.posterior(kind, code)
        vote = np.broadcast_to(PRIOR, r.vote.shape).copy()
        for j in range(len(LABELERS)):
            np.add.at(vote, (kind, j, 1, v[:, j]), count * p)
            np.add.at(vote, (kind, j, 0, v[:, j]), count * (1 - p))
        yes = np.bincount(kind, count * p, n) + prior_true[:, 0]
        r = Reliability(yes / (np.bincount(kind, count, n) + prior_true.sum(axis=1)), vote / vote.sum(axis=3, keepdims=True))
    return r


def fit(kind: np.ndarray, target: np.ndarray, places: list[np.ndarray], true: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on the posteriors, from the kinds' shares of true candidates on."""
    weights, g = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    if not len(target):
        return weights
    x, row = np.concatenate(places), np.repeat(np.arange(len(places)), [len(p) for p in places])
    offset = np.log(true / (1 - true))[kind]
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(offset + np.bincount(row, weights[x], len(target)), -500, 500)))
        d = np.bincount(x, (p - target)[row], 1 << BITS) / len(target) + L2 * weights
        g += d * d
        weights -= RATE * d / np.sqrt(g)
    return weights


@dataclass
class Model:
    reliability: Reliability
    places: np.ndarray
    values: np.ndarray

    def scores(self, kind: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
        weights = np.zeros(1 << BITS)
        weights[self.places] = self.values
        true = self.reliability.true
        margin = np.log(true / (1 - true))[kind] + np.array([weights[p].sum() for p in places])
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


# --- Spark


CANDIDATE = "struct<kind:int,start:int,end:int,votes:int,places:array<int>>"
COUNTS = tuple(f"n_{k}" for k in BASE)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _finder(n: int) -> Callable:
    inner = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.int32()), ("places", pa.list_(pa.int32()))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, digests, found = [[] for _ in BASE], [], []
                for text in part.column(n):
                    text = text.as_py() or ""
                    base = base_spans(text)
                    for k, to in enumerate(counts):
                        to.append(sum(s[0] == k for s in base))
                    digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    own = []
                    for k, a, b in [*base, *_loose(text)]:
                        votes = votes_of(text, KINDS[k], a, b)
                        own.append({"kind": k, "start": a, "end": b, "votes": code_of(votes), "places": features(text, KINDS[k], a, b, votes)})
                    found.append(own)
                cols = [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(found, pa.list_(inner))]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *cols], [*(f"k{i}" for i in range(n)), *COUNTS, "base_sha256", "candidates"])

    return find


def candidates(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """k0, k1, ... (the columns keep), the patterns' counts and digest, and the candidates of each row, in the shared folder."""
    types = [T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(keep)]
    schema = T.StructType([*types, *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_sha256", T.StringType()), *T.StructType.fromDDL(f"candidates array<{CANDIDATE}>")])
    chosen = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("text"))
    return materialise(chosen.mapInArrow(_finder(len(keep)), schema), "candidates")


def train(found: DataFrame, sample: int = SAMPLE) -> Model:
    """Reliabilities from all candidates of candidates(), the classifier from at most `sample` distinct ones."""
    each = found.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.places")
    seen = each.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "votes").toArrow()  # kinds times 3^5 rows at most
    r = estimate(*(seen.column(c).to_numpy() for c in ("kind", "votes", "n")))
    chosen = each.distinct().orderBy(F.xxhash64("kind", "votes", "places"), "kind", "votes", "places").limit(sample)

    def fitted(rows: pa.Table) -> pa.Table:
        rows = sorted(zip(*(rows.column(c).to_pylist() for c in ("kind", "votes", "places")), strict=True))
        kind, code = np.array([x[0] for x in rows]), np.array([x[1] for x in rows])
        weights = fit(kind, r.posterior(kind, code), [np.array(x[2]) for x in rows], r.true)
        at = np.flatnonzero(weights)
        return pa.table({"places": pa.array([at.astype(np.int32)], pa.list_(pa.int32())), "values": pa.array([weights[at]], pa.list_(pa.float64()))})

    got = chosen.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(fitted, "places array<int>, values array<double>").first()
    return Model(r, *(np.array(got[c] if got else [], t) for c, t in (("places", np.int32), ("values", float))))


def settled(own: list[dict], score: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end): base spans, and candidates of at least CUT that overlap none of them nor a better one."""
    spans = [(c["kind"], c["start"], c["end"]) for c in own if c["kind"] < len(BASE)]
    taken: list[tuple[int, int]] = []  # disjoint, sorted
    cover: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if cover and a < cover[-1][1]:
            cover[-1] = (cover[-1][0], max(b, cover[-1][1]))
        else:
            cover.append((a, b))
    taken = cover
    rest = sorted((-s, c["start"], c["start"] - c["end"], c["kind"]) for c, s in zip(own, score.tolist(), strict=True) if c["kind"] >= len(BASE) and s >= CUT)
    for _, a, minus, kind in rest:
        b, i = a - minus, bisect_left(taken, (a, 0))
        if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b):
            insort(taken, (a, b))
            spans.append((kind, a, b))
    return sorted(spans)


def _settler(shared, n: int) -> Callable:
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            lists = batch.column(n).to_pylist()
            flat = [c for own in lists for c in own]
            score = model.scores(np.array([c["kind"] for c in flat], np.int64), [np.array(c["places"], np.int64) for c in flat]) if flat else np.zeros(0)
            spans, at = [], 0
            for own in lists:
                spans.append(settled(own, score[at : at + len(own)]))
                at += len(own)
            more = [pa.array([sum(s[0] >= len(BASE) for s in x) for x in spans], pa.int64()), pa.array([_joined(x) for x in spans], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *more], [*batch.schema.names[:n], "n_added", "spans"])

    return settle


def detect(df: DataFrame, keep: list[str], text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The columns keep of every row of df, and its personal data.

    n_email, n_ip, n_card, n_phone and base_sha256 of the patterns' spans; n_added and spans with those that the
    classifier adds: kind:start:end in code points, end exclusive, by kind (KINDS) and start. A null or empty text has
    none. Rows that repeat are scanned each; an empty df, or one without candidates, gives the patterns' columns and adds
    nothing. Other columns of df are not read; keep may not hold an output's name.
    """
    found = candidates(df, keep, text)
    shared = df.sparkSession.sparkContext.broadcast(train(found, sample))
    n = len(keep) + len(COUNTS) + 1
    schema = T.StructType([*found.schema.fields[:n], T.StructField("n_added", T.LongType()), T.StructField("spans", T.StringType())])
    out = found.mapInArrow(_settler(shared, n), schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *COUNTS, "base_sha256", "n_added", "spans")
