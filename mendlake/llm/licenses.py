"""License scans by diagonal voting.

Templates are word sequences: the short phrases that name a license, one-line notices, headers and whole short licenses.
A text's rolling hashes of two and of four words are joined with the templates' (a fixed table of about 1,300 rows,
broadcast): two words for short templates, four for long ones. A hit of text position p with
template position q lies on the diagonal p - q; hits are counted by diagonal, and diagonals of one template that lie
within SLACK of each other and overlap are merged, as words put in or left out shift the rest of a notice. A merged
span with enough votes is a candidate, and is verified on the text's words: a phrase must stand there word for word, a
notice must share at least COVER of its words in order.

The pass over all texts emits hashes only; spans are verified in a second pass that reads the whole texts again. Texts
are told apart by a hash of the text, so null and repeated ids are no trouble and copies are voted on alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendlake.llm.license_texts import NOTICES, PHRASES, TEXTS
from mendlake.llm.store import materialise, small
from mendlake.llm.words import ALNUM, Words, words

#: Words of a hash: of short templates, and of those of LONG words or more, in whose hashes common words count little.
SHORT_K, LONG_K, LONG = 2, 4, 20
SLACK = 3
#: Share of a notice's hashes that a candidate needs; one changed word spoils as many hashes as they have words.
VOTES = {SHORT_K: 0.5, LONG_K: 0.25}
COVER = 0.75


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    label: str
    phrase: bool

    @property
    def k(self) -> int:
        return LONG_K if len(self.words) >= LONG and not self.phrase else SHORT_K

    def grams(self) -> list[int]:
        raw = np.frombuffer(" ".join(self.words).encode(), np.uint8)
        return Words(raw, np.array([0, len(raw)]), ALNUM).grams(self.k).view(np.int64).tolist()


def templates() -> list[Template]:
    split = lambda t: tuple(re.findall(r"[a-z0-9]+", t.lower()))
    return [Template(split(t), label, i == 0) for i, group in enumerate((PHRASES, NOTICES, TEXTS)) for t, label in group]


def template_grams(spark: SparkSession) -> DataFrame:
    rows = [(i, at, h, t.phrase, t.k, len(g), VOTES[t.k] * len(g)) for i, t in enumerate(templates()) for g in [t.grams()] for at, h in enumerate(g)]
    return spark.createDataFrame(rows, "template int, at int, gram long, phrase boolean, k int, grams int, least double")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, w in words(batch.column(1), ALNUM):
            cut = pa.array(w.first.astype(np.int32))
            for k in (SHORT_K, LONG_K):
                grams = w.grams(k)
                grams = np.concatenate([grams, np.zeros(len(w.hash) - len(grams), np.uint64)])
                # The last words of a text begin no gram; their places are kept, so that positions count words.
                for i in range(1, k):
                    ends = w.first[1:] - i
                    grams[ends[ends >= w.first[:-1]]] = 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(cut, pa.array(grams.view(np.int64)))], ["tkey", "grams"])


def candidates(texts: DataFrame) -> DataFrame:
    """(tkey, found): the candidate spans of each text, as (template, start, end) in words. texts: tkey, text."""
    hashes = texts.mapInArrow(_hashes, "tkey long, grams array<long>").select("tkey", F.posexplode("grams").alias("pos", "gram"))
    hits = hashes.join(F.broadcast(template_grams(texts.sparkSession)), "gram")
    votes = hits.groupBy("tkey", "template", "phrase", "k", "grams", "least", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.countDistinct("at").alias("votes"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    votes = materialise(votes, "votes")
    exact = votes.filter("phrase and votes = grams").select("tkey", "template", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("grams") + F.col("k") - 1).alias("end"))
    # Diagonals of a notice in one text; a run goes on while the next is within SLACK and lies near the former's hits.
    order = W.partitionBy("tkey", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(order) > SLACK) | (F.col("low") > F.lag("high").over(order) + F.col("grams"))
    runs = votes.filter("not phrase").withColumn("run", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(order))
    merged = runs.groupBy("tkey", "template", "k", "least", "run").agg(F.sum("votes").alias("votes"), F.min("low").alias("start"), (F.max("high") + F.col("k")).alias("end"))
    merged = merged.filter("votes >= least").select("tkey", "template", "start", "end")
    both = exact.unionByName(merged)
    return materialise(both.groupBy("tkey").agg(F.array_sort(F.collect_set(F.struct("template", "start", "end"))).alias("found")), "candidates")


SPAN = T.StructType().add("label", "string").add("start", "long").add("end", "long").add("cover", "double")
OUT = T.StructType().add("n_words", "long").add("n_base", "long").add("first_word", "long").add("last_word", "long").add("base_labels", "string").add("labels", "string").add("score", "double").add("spans", T.ArrayType(SPAN))


def cover(text: list[str], template: tuple[str, ...]) -> float:
    """Share of the template's words that stand in text in the same order."""
    blocks = SequenceMatcher(None, text, template, autojunk=False).get_matching_blocks()
    return sum(b.size for b in blocks) / len(template)


def _verifier(n_keep: int) -> Callable:
    known = templates()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(n_keep + 1)
            for a, b, w in words(batch.column(n_keep), ALNUM):
                rows = []
                for i in range(b - a):
                    lo, hi = int(w.first[i]), int(w.first[i + 1])
                    starts, labels, base, spans = [], set(), set(), []
                    for x in found[a + i].as_py() or ():
                        t = known[x["template"]]
                        p, q = x["start"], min(x["end"], hi - lo)
                        if p < 0 or p >= q:
                            continue
                        here = [w.data[w.start[j] : w.end[j]].tobytes().lower().decode() for j in range(lo + p, lo + q)]
                        share = float(here == list(t.words)) if t.phrase else cover(here, t.words)
                        if t.phrase and share:
                            starts.append(p)
                            base.add(t.label)
                        if share >= COVER:
                            labels.add(t.label)
                            spans.append({"label": t.label, "start": p, "end": q, "cover": share})
                    score = max((s["cover"] for s in spans), default=0.0)
                    rows.append((hi - lo, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels | base)), score, spans))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:n_keep]), *cols], [*batch.schema.names[:n_keep], *OUT.names])

    return verify


def scan(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep of every row of df with its licenses.

    n_words; n_base, first_word, last_word: places of the phrases (null without any); base_labels and labels (notices
    too), distinct, sorted and comma-joined; score: the best span's share of its template, 0 without spans; spans.
    A null text is empty. Repeated rows are reported each, an empty df gives an empty result; columns of df other than
    keep and text are not read, and keep may not hold an output's name.
    """
    texts = df.select(F.xxhash64(f"`{text}`").alias("tkey"), F.col(f"`{text}`").cast("string").alias("text"))
    found = candidates(texts)
    schema = T.StructType([*[df.schema[c] for c in keep], *OUT])
    rows = df.select(F.xxhash64(f"`{text}`").alias("tkey"), *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("_text"))
    joined = rows.join(small(found, members=F.size("found")), "tkey", "left").select(*[f"_k{i}" for i in range(len(keep))], "_text", "found")
    return joined.mapInArrow(_verifier(len(keep)), schema)
