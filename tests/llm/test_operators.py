"""WARC, licenses, secrets, toxicity, search, sharding, mixing and tool calls on small cases."""

import base64
import functools
import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from mendlake.llm import crosspolytope, licenses, mixing, queries, secret_scan, sharding, store, toolcalls, toxicity, warc
from mendlake.llm import words as word_hashes
from mendlake.llm.license_texts import NOTICES, PHRASES, TEXTS
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- WARC


def test_warc_round_trip(spark):
    rows = [(3, "http://a b/\n", "<p>ü\r\n\r\nx</p>", 1), (1, None, "<p>ü\r\n\r\nx</p>", 2), (2, "u", None, 3), (5, "u", "", 4), (None, "v", "", 5), (None, "w", "alone", 6), (7, "x", "y" * 3_000_000, 7), (8, "x", "z", 8), (8, "x", "z", 8)]
    index = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string, file int"))
    got = warc.read(index).collect()
    assert len(got) == len(rows) == index.count()
    kinds = sorted((r["page_id"] if r["page_id"] is not None else -1, r["record_type"], r["refers_to"]) for r in got)
    assert kinds == [(-1, "response", None), (-1, "revisit", 2), (1, "response", None), (2, "response", None), (3, "revisit", 1), (5, "revisit", 2), (7, "response", None), (8, "response", None), (8, "response", None)]
    by = {r["page_id"]: r for r in got}
    assert by[1]["payload"].decode() == rows[0][2] and by[3]["payload"] is None and by[3]["payload_digest"] == by[1]["payload_digest"] == warc.digest(rows[0][2].encode())
    assert by[3]["payload_bytes"] == len(rows[0][2].encode()) and by[3]["url"] == "http://a%20b/%0A"
    chosen = warc.read(index.filter("page_id in (7, 2)")).collect()
    assert sorted(r["payload_bytes"] for r in chosen) == [0, 3_000_000]


def test_warc_least_bytes_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.read(warc.write(pages, 3)).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_damage_is_seen():
    raw = warc.record(1, "u", b"abc", warc.digest(b"abc"), None)
    assert warc.parse(raw)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"abc", b"abd"))


# --- licenses


def base_of(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at = sorted((i, label) for p, label in PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


def test_licenses(spark):
    notice = NOTICES[1][0]
    texts = ["MIT License", "the Apache-License and CC-BY, cc by cc by", None, "", "mit", "license mit", "GNU General Public License gnu general public\nLICENSE", "é" * 9 + " apache license", notice.replace("redistribute", "share").replace("terms", "very terms"), "x " * 20_000 + "mit license", "mit license", "mit license"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, template int")
    got = {r["doc_id"]: r for r in licenses.scan(df, ["doc_id"]).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert (got[i]["n_words"], got[i]["n_base"], got[i]["first_word"], got[i]["last_word"], got[i]["base_labels"]) == base_of(t)
        assert set(filter(None, got[i]["base_labels"].split(","))) <= set(got[i]["labels"].split(","))
    assert "gpl" in got[8]["labels"] and 0.75 <= got[8]["score"] <= 1 and got[2]["score"] == 0
    assert licenses.scan(df.limit(0), ["doc_id"]).count() == 0


def voted(text):
    """(labels, score) by the rules of the method on words instead of hashes, one template at a time."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = []
    for t in licenses.templates():
        k, n = t.k, len(t.words)
        hits = {}
        for p in range(len(w) - k + 1):
            for q in range(n - k + 1):
                if w[p : p + k] == list(t.words[q : q + k]):
                    hits.setdefault(p - q, []).append((p, q))
        if t.phrase:
            found += [(t.label, 1.0) for d in hits if d >= 0 and w[d : d + n] == list(t.words)]
            continue
        runs = []
        for d in sorted(hits):
            places = [p for p, _ in hits[d]]
            if runs and d - runs[-1]["last"] <= licenses.SLACK and min(places) <= runs[-1]["high"] + n - k + 1:
                runs[-1]["places"] += places
            else:
                runs.append({"places": places, "votes": 0})
            runs[-1].update(last=d, high=max(places), votes=runs[-1]["votes"] + len({q for _, q in hits[d]}))
        for r in runs:
            if r["votes"] >= licenses.VOTES[k] * (n - k + 1):
                share = licenses.cover(w[min(r["places"]) : max(r["places"]) + k], t.words)
                found += [(t.label, share)] * (share >= licenses.COVER)
    return ",".join(sorted({x for x, _ in found})), max((s for _, s in found), default=0.0)


def test_licenses_on_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in queries.op3_licenses(spark, sf).collect()}
    assert got == {r["doc_id"]: base_of(r["text"]) for r in docs}


def test_license_labels(spark, sf):
    """Labels and scores against voting by brute force: given rows, whole licenses, changed ones and near misses."""
    rng = random.Random(12)
    filler = [f"w{i}" for i in range(200)] + "the of in and this software is to any license".split()
    texts = [t for t, _ in TEXTS] + [t for t, _ in NOTICES]
    for t, _ in (*TEXTS, *NOTICES):
        for share in (0.05, 0.15, 0.3, 0.6):
            words = t.split()
            for i in range(len(words)):
                if rng.random() < share:
                    words[i] = rng.choice(["", "changed", "two words"])
            texts.append(" ".join(rng.choices(filler, k=30) + words + rng.choices(filler, k=30)))
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect() if len(r["text"]) < 4000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(df, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        labels, score = voted(t)
        assert got[i][0] == labels and abs(got[i][1] - score) < 1e-9, t
    assert all(label in got[i][0].split(",") for i, (_, label) in enumerate(TEXTS))


# --- secrets


def brute_spans(text):
    kinds = {
        "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8, re.I | re.A),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16, 0),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32, 0),
    }
    found = [(m.start(), list(kinds).index(k), f"{k}:{m.start()}:{m.end()}") for k, (p, good, flags) in kinds.items() for m in re.finditer(p, text, flags) if good(m)]
    return [len([1 for f in found if f[1] == i]) for i in range(3)], ",".join(x[2] for x in sorted(found))


def test_secrets(spark, sf):
    rng = random.Random(3)
    odd = ["Password='abcdefgh'", "paſſword=abcdefghi", "toKen : short", "AKIA" + "A" * 12, "AKIAAKIA" + "B" * 7, "f" * 31, "f" * 32 + "G", "é " + "0" * 40, None, "", 'API_KEY":"x.y-z/=+12"', "token=" + "a" * 100_000]
    odd += ["".join(rng.choice("passwordtokenAKIA0f=: \"'é") for _ in range(300)) for _ in range(50)]
    rows = [(i, t) for i, t in enumerate(odd)] + [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 1000", "text").collect()]
    got = {r["doc_id"]: r for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    for i, t in rows:
        counts, joined = brute_spans(t or "")
        assert [got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]] == counts
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(got[i]["spans"].split(","))


def test_guess_costs():
    cost = secret_scan.guess_cost
    assert cost("password") < 1 and cost("qwertyuiop") < 3.5 and cost("aaaaaaaaaaaa") < 4 and cost("1999-12-31") < 6 and cost("abcdefgh") < 4
    assert cost("") == 0 and cost("x7Gq2LmZ9pTv") >= 12 and cost("password1999-12-31") < cost("password") + cost("1999-12-31") + 1


KEYS = ["1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm"]


def piece_costs(x, words):
    """The cost of every reading of x as one piece, by the definitions."""
    low, out = x.translate(LOWER), [len(x) * 1.0]
    near = {row[i : i + 2] for row in KEYS for i in range(len(row) - 1)}
    if low in words:
        out.append(words[low] + 0.5 * (x != low))
    for unit in range(1, 5):
        if len(x) % unit == 0 and len(x) >= max(3, 2 * unit) and x[:unit] * (len(x) // unit) == x:
            out.append(unit + math.log10(len(x) // unit))
    if len(x) >= 3 and all(low[i : i + 2] in near or low[i : i + 2][::-1] in near for i in range(len(x) - 1)):
        out.append(math.log10(94 * len(x)))
    turns = {ord(b) - ord(a) for a, b in zip(low, low[1:], strict=False)}
    if len(x) >= 3 and turns in ({1}, {-1}) and low.isalnum():
        out.append(math.log10(52 * len(x)))
    day, month, year = "(0[1-9]|[12][0-9]|3[01])", "(0[1-9]|1[0-2])", "((19|20)[0-9][0-9])"
    for sep in ("", *"-/._"):
        if re.fullmatch(re.escape(sep).join((year, month, day)), x) or re.fullmatch(re.escape(sep).join((day, month, year)), x):
            out.append(math.log10(365 * 130))
    if re.fullmatch(year, x):
        out.append(math.log10(130))
    return min(out)


def least_cost(v, words):
    done = [0.0]
    for j in range(1, len(v) + 1):
        done.append(min(done[i] + (math.log10(2) if i else 0.0) + piece_costs(v[i:j], words) for i in range(j)))
    return done[-1]


def test_guess_costs_are_the_least_of_all_segmentations():
    """1,000 values of walks, words, dates, sequences and repeats that overlap, against all segmentations."""
    known = secret_scan.PASSWORDS
    for v, want in (("dragonmnbvcxzdragonmnbvcxz", 8.45), ("asdfghjklovezxcvbnmaster", 9.37), ("qwertyuiopasswordfghjklzxcvbnm", 9.70)):
        assert round(secret_scan.guess_cost(v), 2) == want
    rng = random.Random(1)
    walks = ["asdfghjkl", "lkjhgfdsa", "qwertrewq", "zxcvbnm", "asasdfdsa", "0987654321", "1234565"]
    atoms = [*walks, "abcdefg", "54321", "fedc", "xyz", "aaaa", "abab", "abcabc", "xyzwxyzw", "2001", "1999-12-31", "31121999", "20200101", "q", "Z", "7", "é", "İ", "ß", "_", *list(known.costs)[:40]]
    for k in range(1000):
        v = ""
        while len(v) < 4 or rng.random() < 0.75:
            x = rng.choice(atoms)
            x = x[rng.randrange(len(x) // 2 + 1) : len(x) - rng.randrange(len(x) // 2 + 1)]
            shared = next((n for n in range(min(3, len(x), len(v)), 0, -1) if v.endswith(x[:n])), 0)  # lie over each other
            v += x[shared:] if rng.random() < 0.8 else x.upper()
        v = v[: 34 if k % 10 else 60]
        assert abs(secret_scan.guess_cost(v) - least_cost(v, known.costs)) < 1e-9, v


def test_guess_costs_of_long_values_take_about_linear_time():
    began = time.perf_counter()
    for v in ("a" * 100_000, "as" * 50_000, "asdf" * 25_000, "abcdcb" * 16_000, "qwertyuiop" * 10_000, "".join(random.Random(4).choices("asdfjkl", k=100_000))):
        assert secret_scan.guess_cost(v) > 0
    assert time.perf_counter() - began < 60


def test_secrets_of_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "password is x7Gq2LmZ9pTvW", 5, "x")], "doc_id long, text string, n_hex int, spans string")
    assert secret_scan.scan(df.limit(0), ["doc_id"]).count() == 0
    got = secret_scan.scan(df.unionByName(df), ["doc_id"]).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0]["n_hex"] == 0 and got[0]["spans"] == "guess:12:25"
    with pytest.raises(FileNotFoundError):
        secret_scan.scan(df, ["doc_id"], vocabulary="/no/such/vocabulary")


def test_guess_costs_of_words(tmp_path):
    """Against all segmentations into words of a vocabulary file and single characters."""
    path = tmp_path / "vocabulary"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate([b"e", b" the", b"THE", b" zebra", b"zeb", b"crossing", b"a1", b"\xff"])))
    known = secret_scan.dictionary(str(path))
    n = len(secret_scan.PASSWORDS.costs)
    assert "e" not in known.costs and "a1" not in known.costs and known.costs["zebra"] == math.log10(n + 2) and known.costs["crossing"] == math.log10(n + 4)
    for v in ("zebracrossing", "xzebra", "zebrazeb", "crossingzq", "qzxv"):

        @functools.cache
        def least(i, v=v):
            if i == len(v):
                return 0.0
            piece = secret_scan.PIECE if i else 0.0
            words = [known.costs[v[i:j]] + least(j) for j in range(i + 1, len(v) + 1) if v[i:j] in known.costs]
            return piece + min(words + [j - i + least(j) for j in range(i + 1, len(v) + 1)])

        assert abs(secret_scan.guess_cost(v, known) - least(0)) < 1e-9, v


def test_many_spans_are_quick():
    text = "\n".join(f"token=abcdefgh{i:08d}" for i in range(20_000))
    began = time.perf_counter()
    spans, _ = secret_scan.find(text)
    assert len(spans) == 20_000 and time.perf_counter() - began < 30


def test_guess_spans():
    spans, most = secret_scan.find("the password is x7Gq2LmZ9pTvW. my pwd: changeme1 http://joe:Zk93jfKs02md@host/ pin -> 12345678")
    assert [s[2] for s in spans] == ["guess", "guess"] and most > 10
    assert secret_scan.find("password is required")[0] == []


# --- toxicity


def test_ordinal_fit_recovers_grades():
    rng = np.random.default_rng(0)
    xs, y = [], []
    for _ in range(1500):
        bad = rng.integers(0, 4) * (rng.random() < 0.5)
        x = np.unique(np.concatenate([rng.integers(100, 2000, 30), rng.choice(20, bad, replace=False)])).astype(np.int32)
        xs.append(x)
        y.append(int(bad))
    y = np.array(y)
    m = toxicity.fit(y[:1000], xs[:1000], (int((y == 0).sum()), int((y > 0).sum())))
    assert (np.diff(m.thresholds) > 0).all() and (m.places < 20).sum() == 20 and len(m.places) < 40
    margin = np.array([m.dense()[x].sum() for x in xs[1000:]], float)
    p, severity, grade = m.grades(margin)
    assert ((p >= 0.5) == (y[1000:] > 0)).mean() > 0.95
    assert np.corrcoef(severity, y[1000:])[0, 1] > 0.9 and (grade == y[1000:]).mean() > 0.8
    assert ((severity >= 0) & (severity <= 3)).all()


def test_toxicity_held_out_and_hard_cases(spark):
    rng = random.Random(6)
    clean = [" ".join(f"w{rng.randrange(300)}" for _ in range(40)) for _ in range(400)]
    docs = [(i, t + (" you awfulish pest" if i % 4 == 0 else "")) for i, t in enumerate(clean)]
    labels = [(i, 1, int(i % 4 == 0)) for i, _ in docs[:300]]
    df = spark.createDataFrame([*docs, (900, None), (901, ""), (None, "awfulish pest")], "doc_id long, text string").withColumn("grade", F.lit("mine"))
    m = toxicity.train(df.select("doc_id", "text"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = toxicity.score(df, m)
    assert got.columns == ["doc_id", "text", "p_toxic", "severity", "grade", "toxic"] and got.count() == 403
    found = {r["doc_id"]: r["toxic"] for r in got.collect()}
    assert all(found[i] == (i % 4 == 0) for i in range(300, 400)) and not found[900] and not found[901]
    none = toxicity.train(df.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score(df, none).filter("toxic").count() == 0
    assert toxicity.score(df.limit(0), m).count() == 0


def test_fit_is_the_optimum():
    """One feature, grades 0 to 2: the fit against the most likely parameters by brute force."""
    rng = np.random.default_rng(5)
    x = rng.random(4000) < 0.4
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    true = np.array([0.8, 1.5]), 2.0
    u = rng.random(4000)
    grade = (u[:, None] > sigmoid(true[0] - true[1] * x[:, None])).sum(axis=1)

    def loss(a, step, w):
        theta = np.array([-np.inf, a, a + step, np.inf])
        p = sigmoid(theta[grade + 1] - w * x) - sigmoid(theta[grade] - w * x)
        return -np.log(np.maximum(p, 1e-12)).mean()

    best = [0.5, 0.5, 0.5]
    size = 0.5
    while size > 1e-3:  # coordinate descent
        moves = [[*best[:i], best[i] + d, *best[i + 1 :]] for i in range(3) for d in (size, -size)]
        low = min((m for m in moves if m[1] > 0), key=lambda m: loss(*m))
        best, size = (low, size) if loss(*low) < loss(*best) else (best, size / 2)
    counts = int((grade == 0).sum()), int((grade > 0).sum())
    m = toxicity.fit(grade, [np.array([7] * int(v), np.int32) for v in x], counts)
    want = toxicity.Model(np.array([7]), np.array([best[2]]), np.array([best[0], best[0] + best[1]]))
    for margin in (0.0, 1.0):
        got, right = m.grades(np.array([margin * m.dense()[7]])), want.grades(np.array([margin * best[2]]))
        assert abs(got[0][0] - right[0][0]) < 0.02 and abs(got[1][0] - right[1][0]) < 0.03


def test_toxicity_sample_has_the_labels_proportions(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)], "doc_id long, toxic int")
    for most, least, want in ((200, 5, {0: 180, 1: 20}), (200, 50, {0: 180, 1: 50}), (5000, 5, {0: 900, 1: 100})):
        sample, counts = toxicity.examples(docs, labels, most, least)
        assert counts == (900, 100) and {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()} == want


def test_toxicity_query(spark, sf):
    """The whole table's scores against features and formulas written out in plain Python."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    weights = dict(zip(model.places.tolist(), model.values.astype(float).tolist(), strict=True))
    top, base = 2**64, int(word_hashes.BASE)
    mixed = lambda x, seed: int(word_hashes.mix(np.array([x], np.uint64), seed)[0])
    seen = {}

    def places(word):
        if word not in seen:
            data = word.encode()
            h = mixed((sum((b + 1) * pow(base, i, top) for i, b in enumerate(data)) + len(data)) % top, 0)
            out = [mixed(h, 1) >> 44]
            for n in (4, 5, 6):
                if len(data) > n:
                    p = 0
                    for b in data[:n]:
                        p = (p * base + b + 1) % top
                    out.append(mixed(mixed(p, n), n) >> 44)
            seen[word] = out
        return seen[word]

    got = {r["doc_id"]: r for r in queries.op1_toxicity(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").translate(LOWER))
        margin = sum(weights.get(p, 0.0) for p in {p for w in set(words) for p in places(w)})
        at_most = [1 / (1 + math.exp(margin - t)) for t in model.thresholds]
        severity = sum(1 - p for p in at_most)
        assert abs(got[r["doc_id"]]["p_toxic"] - (1 - at_most[0])) < 1e-5 and abs(got[r["doc_id"]]["severity"] - severity) < 1e-5
        assert got[r["doc_id"]]["toxic"] == (got[r["doc_id"]]["p_toxic"] >= toxicity.CUT) == (got[r["doc_id"]]["grade"] > 0)


def test_one_class_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 50 + [(2, "d e f")], "doc_id long, text string")
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    sample, counts = toxicity.examples(docs, labels([(1, 1), (2, 0)]))
    assert sample.count() == 2 and counts == (1, 1)
    for toxic in (0, 1):
        m = toxicity.train(docs, labels([(1, toxic), (2, toxic)]))
        assert {r["toxic"] for r in toxicity.score(docs.withColumn("Grade", F.lit(3)), m).collect()} == {bool(toxic)}


# --- nearest neighbours


def test_hadamard():
    x = np.random.default_rng(0).normal(size=(3, 8))
    h = np.array([[(-1.0) ** bin(i & j).count("1") for j in range(8)] for i in range(8)]) / np.sqrt(8)
    assert np.allclose(crosspolytope.hadamard(x), x @ h) and np.allclose(np.linalg.norm(crosspolytope.rotate(x, 1), axis=1), np.linalg.norm(x, axis=1))


def exact(rows, every, k):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))}
    out = {}
    for q in good:
        if q % every == 0:
            s = sorted(((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q))[:k]
            out[q] = [(i, -x) for x, i in s]
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_search(spark, scale):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        v = rng.normal(size=16)
        v = v / np.linalg.norm(v) * (rng.uniform(0.2, 3) if scale else 1)
        rows.append((i, v.tolist()))
    same = rows[7][1]
    rows += [(1000 + i, same) for i in range(200)] + [(2000, None), (2020, [0.0] * 16), (2040, [1.0, None] * 8), (2060, [float("nan")] * 16), (None, same), (2080, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    want = exact([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows if i != 2080], 20, 20)  # 2080: alone of its length
    got = {}
    for r in crosspolytope.search(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    recall = []
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        recall.append(len({f[1] for f in found} & {i for i, _ in want[q]}) / 20)
        exact_scores = {i: s for i, s in exact([(q, dict(rows)[q])] + [(i, v) for i, v in rows if i in {f[1] for f in found}], 20, 20).get(q, [])}
        assert all(abs(exact_scores[f[1]] - f[2]) < 1e-5 for f in found if f[1] in exact_scores)
    assert np.mean(recall) >= 0.9


def test_search_small(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in crosspolytope.search(df).collect())
    # Two rows of one id: each is a query, and the other's neighbour.
    assert [g[:3] for g in got] == [(20, 1, 20), (20, 1, 20), (20, 2, 1), (20, 2, 1)]
    assert crosspolytope.search(df.limit(0)).count() == 0
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(15)]  # fewer than k: all of them
    got = crosspolytope.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(r["vec_id"] for r in got) == list(range(1, 15)) and {r["query_id"] for r in got} == {0}
    rows += [(40, [1.0, 2.0]), (41, [3.0, 1.0]), (43, [1.0, 1.0])]  # of another length: searched among themselves
    got = crosspolytope.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).filter("query_id = 40").collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 41, 5.0), (2, 43, 3.0)]


@pytest.mark.parametrize("norms", ["mixed", "outlier"])
def test_search_norms(spark, norms):
    """Vectors of 64 whose lengths differ, or one of which is much longer: recall stays above 0.9."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= rng.uniform(0.5, 1.5, (2000, 1)) if norms == "mixed" else np.where(np.arange(2000) == 7, 2, 1)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = exact(rows, 20, 20)
    got = {(r["query_id"], r["vec_id"]) for r in crosspolytope.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got & {(q, i) for q, best in want.items() for i, _ in best}) >= 0.9 * 20 * len(want)


# --- sharding


def test_fill():
    names = [f"s{i}" for i in range(7)]
    owner = sharding.fill(names, 997)
    counts = np.bincount(owner)
    assert len(owner) == 997 and counts.max() - counts.min() <= 1
    fewer = sharding.fill(names[:-1], 997)
    moved = sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 6)
    assert moved < 0.35 * 997
    weighted = np.bincount(sharding.fill(names[:2], 997, weights=[3, 1]))
    assert abs(weighted[0] / weighted[1] - 3) < 0.05
    for bad in ((["a", "a"], 7, None), ([], 7, None), (["a"], 8, None), (["a"], 7, [0])):
        with pytest.raises(ValueError):
            sharding.fill(*bad)


def test_place(spark):
    df = spark.createDataFrame([(1, "a", 5), (None, "b", 6), (1, "a", 7)], "doc_id long, shard string, Slot int")
    got = sharding.place(df, "doc_id", ["x", "y"])
    assert got.columns == ["doc_id", "shard", "Slot", "_slot", "_shard", "shard_name"] and got.count() == 3 and got.filter("_shard is null or shard is null").count() == 0
    assert sharding.place(df.select("doc_id"), "doc_id", ["x"]).columns == ["doc_id", "slot", "shard", "shard_name"]
    assert sharding.place(df.limit(0), "doc_id", ["x"]).count() == 0
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


# --- mixing


def greedy_fill(children, budget):
    """Water-filling by repeated rounds."""
    given, open_ = {}, dict(children)
    while open_:
        total = sum(w for w, _ in open_.values())
        full = {k: c for k, (w, c) in open_.items() if total > 0 and c <= budget * w / total}
        if not full:
            return given | {k: (budget * w / total if total else 0) for k, (w, _) in open_.items()}
        for k, c in full.items():
            given[k] = c
            budget -= c
            del open_[k]
    return given


def test_water_fill(spark):
    rng = random.Random(8)
    for _ in range(5):
        kids = {f"c{i}": (float(rng.randrange(1, 5)), float(rng.randrange(0, 50))) for i in range(6)}
        budget = float(rng.randrange(0, 200))
        df = spark.createDataFrame([("p", k, w, c, budget) for k, (w, c) in kids.items()], "parent string, node string, weight double, cap double, budget double")
        got = {r["node"]: r["out"] for r in mixing.water_fill(df, ["parent"], "budget", "out").collect()}
        want = greedy_fill(kids, budget)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_mixing_hard_cases(spark):
    rows = [(i, "a b c d", "en", "src1") for i in range(50)] + [(100, None, None, None), (101, "", "xx", "y"), (None, "q r", "en", "src1"), (5, "a b c d", "en", "src1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("tokens", F.lit("mine"))
    for fraction, epochs in ((0.5, 2), (1.5, 3), (0.0, 1)):
        got = mixing.choose(df, {}, fraction, epochs).collect()
        taken = sum(r["tokens"] for r in got)
        total = 4 * 51 + 2
        assert min(fraction, epochs) * total - 4 <= taken <= min(fraction, epochs) * total + 8
        assert all(r["epoch"] < epochs for r in got)
    assert mixing.choose(df.limit(0), {}).count() == 0


def test_mixing_finds_the_bucket(spark):
    old, mixing.ROWS_A_BUCKET = mixing.ROWS_A_BUCKET, 3
    try:
        df = spark.createDataFrame([(i, "w " * (i % 9), "en", f"src{i % 3}") for i in range(300)], "doc_id long, text string, lang string, source string")
        few = sorted(map(tuple, mixing.choose(df, {"source": {"src0": 3.0}}, 0.4, 2).collect()))
        mixing.ROWS_A_BUCKET = 10_000
        assert few == sorted(map(tuple, mixing.choose(df, {"source": {"src0": 3.0}}, 0.4, 2).collect()))
    finally:
        mixing.ROWS_A_BUCKET = old


# --- tool calls


def test_tool_calls(spark):
    P = toolcalls.Param
    schemas = {"t": [P("x", "integer", least=0), P("y", "string", required=False)]}
    calls = [
        (1, "a", 1, "t", '{"x": 1}', ["b"]), (1, "b", 0, "t", '{ "y":"z", "x":2}', []), (1, "c", 2, "t", '{"x":"1"}', ["a", "b"]), (1, "d", 3, "t", '{"x":-1,"q":[]}', ["e"]), (1, "e", 3, "u", "{}", ["d"]),
        (1, "f", 4, "t", "not json", ["e", "nowhere"]), (1, "a", 9, "t", "{}", []), (2, "a", 0, "t", None, None), (None, None, 0, None, "[]", None), (3, "g", 0, "t", '{"y":null}', ["nowhere"]),
    ]
    results = [(1, "a", 2, 'say "hi"'), (1, "a", 5, "again"), (9, "zz", 1, None)]
    c = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, depends array<string>")
    r = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string")
    got = {(x["conv_id"], x["call_id"]): x for x in toolcalls.link(c, r, schemas).collect()}
    assert {k: v["level"] for k, v in got.items()} == {(1, "a"): 1, (1, "b"): 0, (1, "c"): 2, (1, "d"): None, (1, "e"): None, (1, "f"): None, (2, "a"): 0, (-1, ""): 0, (3, "g"): 0, (9, "zz"): None}
    assert got[1, "b"]["json"] == '{"arguments":{"x":2,"y":"z"},"id":"b","name":"t"}' and got[1, "b"]["errors"] == ""
    assert got[1, "a"]["json"] == '{"arguments":{"x":1},"id":"a","name":"t","result":"say \\"hi\\""}' and (got[1, "a"]["n_calls"], got[1, "a"]["n_results"]) == (2, 2)
    assert got[1, "c"]["errors"] == "type:x" and got[1, "d"]["errors"] == "unknown:q,range:x" and got[1, "e"]["errors"] == "tool" and got[1, "f"]["errors"] == "json"
    assert got[2, "a"]["errors"] == "json" and got[-1, ""]["errors"] == "json" and got[3, "g"]["errors"] == "missing:x,type:y"
    assert got[9, "zz"]["status"] == "orphan" and got[1, "d"]["status"] == "unanswered"
    assert toolcalls.link(c.limit(0), r.limit(0), schemas).count() == 0


# --- the shared folder


def test_materialise_and_small(spark):
    df = store.materialise(spark.range(5), "t")
    assert df.count() == 5 and store.small(df, 4) is df
    store.drop_table(df)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(df.inputFiles()[0]).count()


def test_mixing_of_one_key(spark):
    """A null id with many rows of few lengths: the choice is the one that rows by themselves would give."""
    rng = random.Random(9)
    rows = [(None, "w " * rng.randrange(0, 6), "en", "s1") for _ in range(4000)] + [(i % 50, "v " * (1 + i % 3), "en", "s1") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.choose(df, {}, 0.3, 2, 5).groupBy("doc_id", "tokens", "epoch").count().collect()
    tokens = [(i, len(t.split())) for i, t, _, _ in rows]
    total = sum(n for _, n in tokens)
    budget = math.floor(total * 0.3 + 1e-6)
    digest = lambda i: int(hashlib.md5(f"5:0:{'' if i is None else i}".encode()).hexdigest()[: mixing.HEX], 16)
    taken, before = {}, 0
    for i, n in sorted(tokens, key=lambda x: (digest(x[0]), x[0] is not None, x[0] or 0, x[1])):
        if before < budget:
            taken[i, n, 0] = taken.get((i, n, 0), 0) + 1
        before += n
    assert {(r["doc_id"], r["tokens"], r["epoch"]): r["count"] for r in got} == taken
