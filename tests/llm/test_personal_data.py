"""Personal data: patterns and estimates against brute force, added spans against planted truth."""

import hashlib
import math
import random
import re
import time
from collections import defaultdict

import numpy as np
from mendlake.llm import personal_data as pii
from mendlake.llm import queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, x):
    digits = [int(c) for c in x if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_of(text):
    """(counts, digest, spans) of the contract's patterns."""
    spans = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    return tuple(sum(s[0] == k for s in spans) for k in PATTERNS), hashlib.sha256(joined.encode()).hexdigest(), spans


def odd_texts(n, seed):
    rng = random.Random(seed)
    atoms = ["a", "Z9", "@", ".", "-", "_", "+", " ", "1", "255", "256", "00012", "4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "+1 (743) 555-3824", "x@y.zz", "é", "10.0.0.1", "..", "@a.b@c.d", "(", ")", "\n", "+49", "3782 822463 10005"]
    return ["".join(rng.choices(atoms, k=rng.randrange(1, 25))) for _ in range(n)]


def test_patterns_against_brute_force():
    for text in odd_texts(20_000, 4):
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == base_of(text)[2], text


def test_long_runs_take_linear_time():
    began = time.time()
    for run in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" + " " * 300_000, "1 " * 150_000, "A" * 300_000, "@" * 300_000, "a@b." * 80_000, "Ab " * 100_000):
        pii.base_spans(run)
        list(pii._loose(run))
    assert time.time() - began < 30


def test_query_on_rows(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op11_personal_data(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        counts, digest, spans = base_of(docs[r["doc_id"]])
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == (*counts, digest)
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(filter(None, r["spans"].split(",")))


def planted(n, seed):
    """(text, truth) with personal data among look-alikes: versions, order numbers, headings."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choices("23456789", k=k))
    filler = "the of and report about water over there with small green old many from when".split()
    rows = []
    for _ in range(n):
        parts, truth = [], []
        for _ in range(rng.randrange(1, 5)):
            parts.append((" ".join(rng.choices(filler, k=rng.randrange(2, 9))), None))
            local, date = f"{num(3)}-{num(3)}-{num(4)}", f"19{rng.randrange(40, 99)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)}"
            name = f"{rng.choice(['Maria', 'Peter', 'Lucas', 'Anna', 'John', 'Karin'])} {rng.choice(['Brendt', 'Okoro', 'Silva', 'Varga'])}"
            parts += rng.choice([
                [("phone:", None), (local, "local_phone")], [("call me at", None), (local, "local_phone")], [("order", None), (local, "")], [("part no.", None), (local + "-7", "")],
                [("my name is", None), (name, "name")], [("Dear", None), (name, "name")], [("Company", None), ("Green Water Works", "")], [("born on", None), (date, "birth_date")],
                [("version", None), (date, "")], [("released", None), (date, "")], [("my ssn is", None), (f"5{num(2)}-{num(2)}-{num(4)}", "identity")], [("write to", None), (f"user{num(2)} [at] mail [dot] com", "written_email")],
                [("mail", None), (f"u{num(3)}@mail.com", None)], [("call", None), (f"+1 {num(3)} {num(3)} {num(4)}", None)],
            ])
        text = ""
        for x, kind in parts:
            start = len(text)
            text += x + " "
            if kind:
                truth.append(f"{kind}:{start}:{start + len(x)}")
        rows.append((text, truth))
    return rows


def added(spans):
    return {x for x in filter(None, spans.split(",")) if x.split(":")[0] not in pii.BASE}


def test_added_spans_against_planted_truth(spark):
    """Precision and recall of what is added; look-alikes stay out."""
    rows = planted(600, 8)
    got = pii.detect(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string"), ["doc_id"]).collect()
    hits = sum(len(added(r["spans"]) & set(rows[r["doc_id"]][1])) for r in got)
    n_added, n_true = sum(len(added(r["spans"])) for r in got), sum(len(t) for _, t in rows)
    assert n_added == sum(r["n_added"] for r in got)
    assert hits / n_true > 0.93 and hits / n_added > 0.93, (hits, n_true, n_added)


def slow_posteriors(seen):
    """Expectation-maximisation over single candidates (kind, votes), by the formulas, without numpy."""
    true = {k: pii.PRIOR_TRUE[k in pii.BASE] for k in pii.KINDS}
    pi = {k: t[0] / sum(t) for k, t in true.items()}
    rate = {(k, j, y, v): pii.PRIOR[y][v] / sum(pii.PRIOR[y]) for k in pii.KINDS for j in range(5) for y in (0, 1) for v in range(3)}

    def p_true(k, votes):
        like = [math.prod(rate[k, j, y, v + 1] for j, v in enumerate(votes)) * (pi[k] if y else 1 - pi[k]) for y in (0, 1)]
        return like[1] / sum(like)

    for _ in range(pii.ROUNDS):
        ps = [p_true(*s) for s in seen]
        add = defaultdict(float)
        for (k, votes), p in zip(seen, ps, strict=True):
            for j, v in enumerate(votes):
                add[k, j, 1, v + 1] += p
                add[k, j, 0, v + 1] += 1 - p
        pi = {k: (true[k][0] + sum(p for s, p in zip(seen, ps, strict=True) if s[0] == k)) / (sum(true[k]) + sum(s[0] == k for s in seen)) for k in pii.KINDS}
        for k in pii.KINDS:
            for j in range(5):
                for y in (0, 1):
                    total = sum(pii.PRIOR[y]) + sum(add[k, j, y, v] for v in range(3))
                    for v in range(3):
                        rate[k, j, y, v] = (pii.PRIOR[y][v] + add[k, j, y, v]) / total
    return [p_true(*s) for s in seen]


def test_estimates_and_spans_against_brute_force(spark):
    """The whole result from counts over Spark against one that holds all candidates in lists."""
    texts = [t for t, _ in planted(60, 9)]
    texts += [texts[0]] * 40 + [None, "", "none here"] + odd_texts(40, 10)
    rows = []
    for text in texts:
        text = text or ""
        found = [(pii.KINDS.index(k), a, b) for k, a, b in base_of(text)[2]] + list(pii._loose(text))
        rows.append([(k, a, b, pii.votes_of(text, pii.KINDS[k], a, b)) for k, a, b in found])
    seen = [(pii.KINDS[k], v) for own in rows for k, _, _, v in own]
    posterior = dict(zip(seen, slow_posteriors(seen), strict=True))
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_email int, kind string")
    found = pii.candidates(df, ["doc_id"])
    model = pii.train(found)
    kinds = np.array([pii.KINDS.index(k) for k, _ in seen])
    assert np.allclose(model.reliability.posterior(kinds, np.array([pii.code_of(v) for _, v in seen])), [posterior[s] for s in seen])
    got = {r["doc_id"]: r for r in pii.detect(df, ["doc_id"]).collect()}
    assert len(got) == len(texts)
    for i, own in enumerate(rows):
        text = texts[i] or ""
        base = [c for c in own if c[0] < 4]
        places = [np.array(pii.features(text, pii.KINDS[k], a, b, v)) for k, a, b, v in own]
        score = model.scores(np.array([c[0] for c in own], int), places) if own else []
        chosen = [c[:3] for c in base]
        for s, (k, a, b, _) in sorted(zip(score, own, strict=True), key=lambda x: (-x[0], x[1][1], x[1][1] - x[1][2], x[1][0])):
            if k >= 4 and s >= pii.CUT and all(b <= x or y <= a for _, x, y in chosen):
                chosen.append((k, a, b))
        assert got[i]["spans"] == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(chosen))
        assert (got[i]["n_email"], got[i]["base_sha256"]) == (base_of(text)[0][0], base_of(text)[1])


def test_sample_bound_and_empty_tables(spark):
    texts = [t for t, _ in planted(80, 11)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert pii.detect(df, ["doc_id"], sample=10).count() == 80
    assert pii.detect(df.limit(0), ["doc_id"]).count() == 0
    quiet = pii.detect(df.selectExpr("doc_id", "'nothing at all' as text"), ["doc_id"]).collect()
    assert len(quiet) == 80 and not any(r["n_added"] or r["spans"] for r in quiet)


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a@b.cd"), (1, "a@b.cd"), (None, "a@b.cd 10.1.1.1")], "doc_id long, text string")
    assert sorted(r["spans"] for r in pii.detect(df, ["doc_id"]).collect()) == ["email:0:6", "email:0:6", "email:0:6,ip:7:15"]
