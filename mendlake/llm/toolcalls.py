"""Tool calls of chats: linked to their results, topologically ordered, validated and serialised.

Calls and results are hash-joined by conversation and identifier. Both sides have one row an identifier by then (the
first of each, found by a map-side aggregate; the others are counted), so a repeated identifier is never a product.
A call's level is one more than the highest level of the calls it depends on; rows sorted by level, turn and identifier
stand in topological order in each conversation. Levels are found by contracting chains (see levels()): a chain of n
calls takes log n rounds of joins, and a conversation is never gathered in one task. Arguments are JSON that is checked
against a schema for each tool; canonical JSON has sorted keys and no white space.

DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendlake.llm.store import materialise, small

KEY = ["conv_id", "call_id"]
#: Above every level: calls on or behind a cycle.
ENDLESS = 1 << 40


@dataclass(frozen=True)
class Param:
    """type: string, integer, number, boolean, array or object. Bounds are for numbers."""

    name: str
    type: str
    required: bool = True
    least: float | None = None
    most: float | None = None


TYPES = {"string": "^STRING$", "integer": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY<.*$", "object": "^OBJECT<.*$"}


#: How a schema calls a number, whose kind may change with how it is written.
NUMBER = r"BIGINT|DOUBLE|FLOAT|DECIMAL\([0-9]+,[0-9]+\)"


def _param_errors(value: Column, keys: Column, p: Param) -> Column:
    path = f"$['{p.name}']"
    there = F.array_contains(keys, p.name)
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    number = F.try_variant_get(value, path, "double")
    typed = F.coalesce(kind.rlike(TYPES[p.type]), F.lit(False))
    if p.type == "integer":  # by value: 3.0 and 3e0 are 3
        typed &= F.coalesce(number == F.rint(number), F.lit(False))
    bad = F.lit(False)
    if p.least is not None:
        bad |= F.coalesce(number < F.lit(p.least), F.lit(False))
    if p.most is not None:
        bad |= F.coalesce(number > F.lit(p.most), F.lit(False))
    missing = F.lit(f"missing:{p.name}") if p.required else F.lit(None).cast("string")
    return F.when(~there, missing).when(~typed, F.lit(f"type:{p.name}")).when(bad, F.lit(f"range:{p.name}"))


def strict(text: Column) -> Column:
    """A text that is one JSON value and nothing else, as a variant; else null.

    The parser reads one value and leaves what follows, so the text must stand in a list and in an object: whatever
    comes behind a value can't end both. Numbers that don't come back as numbers are refused (1e400), and so is what the
    parser takes for none: numbers of more than 1,000 digits, values nested 1,000 deep, members that repeat.
    """
    listed, held = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    one = listed.isNotNull() & held.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    value = F.try_parse_json(text)
    back = F.schema_of_variant(F.try_parse_json(F.to_json(value)))
    return F.when(one & (F.regexp_replace(back, NUMBER, "n") == F.regexp_replace(F.schema_of_variant(value), NUMBER, "n")), value)


def errors(name: Column, arguments: Column, value: Column, schemas: dict[str, list[Param]]) -> Column:
    """Comma-joined errors of a call, '' if it is valid: json, tool, unknown:key, missing:, type: and range:key.

    value: strict() of the arguments.
    """
    keys = F.array_sort(F.coalesce(F.map_keys(F.from_json(arguments, "map<string,string>")), F.array().cast("array<string>")))
    out = F.lit("tool")
    for tool, params in sorted(schemas.items()):
        known = F.array(*[F.lit(p.name) for p in params]) if params else F.array().cast("array<string>")
        unknown = F.transform(F.array_except(keys, known), lambda k: F.concat(F.lit("unknown:"), k))
        found = F.concat(unknown, F.array_compact(F.array(*[_param_errors(value, keys, p) for p in params]))) if params else unknown
        out = F.when(name == tool, F.array_join(found, ",")).otherwise(out)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT<"), F.lit(False))
    return F.when(~is_object, F.lit("json")).otherwise(out)


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of unique calls with `depends` (array of ids); a dependency that isn't a call of the
    conversation is ignored. Calls on a cycle or behind one have no row.

    The level of a call is the maximum of a bound and of its open dependencies' levels, plus a step each. While there
    are edges: dependencies with a known level become part of the bound; calls without open dependencies are known;
    chains of calls with one open dependency are contracted to their ends by pointer doubling, and put aside until those
    are known. Every pass does away with all chains and all calls that depend on known ones or on one chain's end only,
    so passes grow with the nesting of calls that wait for two open ones, not with the length of chains. If a pass finds
    neither, all calls that are left wait for two of each other: they are on cycles or behind them.
    """
    edges = calls.select(*KEY, F.explode(F.array_distinct("depends")).alias("dep"))
    nodes = calls.select(*KEY)
    edges = edges.join(nodes.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_semi")
    # An edge: the call's level is at least the dependency's and `step`; at least `step` where dep is null.
    edges = materialise(edges.select(*KEY, "dep", F.lit(1).cast("long").alias("step")), "call-edges")
    known = materialise(nodes.join(edges.select(*KEY).distinct(), KEY, "left_anti").withColumn("level", F.lit(0).cast("long")), "levels")
    found, aside = [known], []
    edges = materialise(_shortened(edges, known), "call-edges")
    while not edges.isEmpty():
        state = edges.groupBy(*KEY).agg(F.count("dep").alias("open"), F.max(F.when(F.col("dep").isNull(), F.col("step"))).alias("least"), F.max(F.when(F.col("dep").isNotNull(), F.struct("dep", "step"))).alias("one"))
        state = materialise(state, "call-state")
        known = state.filter("open = 0").select(*KEY, F.col("least").alias("level"))
        ones = state.filter("open = 1").select(*KEY, F.col("one.dep").alias("to"), F.col("one.step").alias("step"), F.coalesce("least", F.lit(0)).alias("least"))
        if state.filter("open < 2").isEmpty():
            break
        ones = _contracted(ones)
        found.append(known)
        aside.append(ones)
        many = edges.join(state.filter("open > 1").select(*KEY), KEY, "left_semi")
        edges = materialise(_shortened(many, known, ones), "call-edges")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    for ones in reversed(aside):  # each waits for calls that were known, or put aside, after it
        ends = out.select("conv_id", F.col("call_id").alias("to"), "level")
        level = F.greatest("least", F.col("level") + F.col("step"))
        out = materialise(out.unionByName(ones.join(ends, ["conv_id", "to"]).select(*KEY, level.alias("level"))), "levels")
    return out.filter(F.col("level") < ENDLESS).withColumn("level", F.col("level").cast("int"))


def _shortened(edges: DataFrame, known: DataFrame, ones: DataFrame | None = None) -> DataFrame:
    """edges with known dependencies as bounds and those on a chain moved to its end, the largest step of each."""
    ends = known.select("conv_id", F.col("call_id").alias("dep"), "level", F.lit(None).cast("string").alias("to"), F.lit(None).cast("long").alias("more"))
    if ones is not None:
        ends = ends.unionByName(ones.select("conv_id", F.col("call_id").alias("dep"), F.col("least").alias("level"), "to", F.col("step").alias("more")))
    met = edges.join(small(ends), ["conv_id", "dep"], "left")
    bound = F.struct(F.lit(None).cast("string").alias("dep"), (F.col("level") + F.col("step")).alias("step"))
    moved = F.struct(F.col("to").alias("dep"), (F.col("more") + F.col("step")).alias("step"))
    kept = F.struct("dep", "step")
    rows = F.when(F.col("level").isNull(), F.array(kept)).when(F.col("to").isNull() | (F.col("level") >= ENDLESS), F.array(bound)).otherwise(F.array(bound, moved))
    return met.select(*KEY, F.inline(rows)).groupBy(*KEY, "dep").agg(F.max("step").alias("step"))


def _contracted(ones: DataFrame) -> DataFrame:
    """Calls with one open dependency (to, step, least), each with the end of its chain, a call of another kind, as `to`.

    level = max(least, level of to + step); two such calls in a row make one. Each round doubles what a pointer spans,
    so pointers that are still inside after enough rounds for all calls go round a cycle: their level is ENDLESS."""
    for _ in range(max(1, ones.count()).bit_length() + 1):
        then = ones.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("step").alias("next_step"), F.col("least").alias("next_least"))
        met = materialise(ones.join(then, ["conv_id", "to"], "left"), "call-chains")
        ended = met.filter("next is null").select(*KEY, "to", "step", "least")
        inside = met.filter("next is not null")
        if inside.isEmpty():
            return ended
        step = (F.col("step") + F.col("next_step")).alias("step")
        least = F.greatest("least", F.col("next_least") + F.col("step")).alias("least")
        ones = ended.unionByName(inside.select(*KEY, F.col("next").alias("to"), step, least))
    ends = ones.select("conv_id", F.col("call_id").alias("to"), F.lit(True).alias("inside"))
    met = ones.join(ends, ["conv_id", "to"], "left")
    return materialise(met.select(*KEY, "to", "step", F.when(F.col("inside"), F.lit(ENDLESS)).otherwise(F.col("least")).alias("least")), "call-chains")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, list[Param]]) -> DataFrame:
    """A row for every call identifier and every result without a call.

    calls: conv_id, call_id, turn, name, arguments, depends; results: conv_id, call_id, turn, content. Out: conv_id,
    call_id, turn, name, status (answered, unanswered or orphan), n_calls, n_results, level, errors, json. Of calls or
    results with one identifier the first (by turn, then content) counts and the others are only counted. Null
    conversations or identifiers are read as '' (texts) and -1 (numbers). level is null for orphans and for calls on or
    behind a cycle. json holds arguments (as text if they aren't JSON), error, id, name and result. Empty tables give
    an empty result; further columns are not read.
    """
    keyed = lambda df: df.withColumn("conv_id", F.coalesce(F.col("conv_id").cast("long"), F.lit(-1))).withColumn("call_id", F.coalesce(F.col("call_id").cast("string"), F.lit("")))
    key = ["conv_id", "call_id"]
    first = keyed(calls).groupBy(*key).agg(F.min(F.struct("turn", "name", "arguments", "depends")).alias("c"), F.count(F.lit(1)).alias("n_calls"))
    first = materialise(first.select(*key, "c.turn", "c.name", "c.arguments", F.coalesce("c.depends", F.array().cast("array<string>")).alias("depends"), "n_calls"), "calls")
    answers = keyed(results).groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    both = first.join(answers.hint("shuffle_hash"), key, "full").join(levels(first), key, "left")
    both = both.withColumn("value", strict(F.col("arguments")))  # a column of its own: it is parsed once
    both = both.withColumn("wrong", F.when(F.col("n_calls").isNotNull(), errors(F.col("name"), F.col("arguments"), F.col("value"), schemas)))
    wrong = F.col("wrong")
    status = F.when(F.col("n_calls").isNull(), "orphan").when(F.col("n_results").isNull(), "unanswered").otherwise("answered")
    parts = {
        "arguments": F.coalesce(F.to_json("value"), _quoted(F.col("arguments"))),
        "error": F.when(wrong != "", _quoted(wrong)),
        "id": _quoted(F.col("call_id")),
        "name": _quoted(F.col("name")),
        "result": _quoted(F.col("r.content")),
    }
    members = F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in sorted(parts.items())])
    return both.select(*key, F.coalesce("turn", "r.turn").alias("turn"), "name", status.alias("status"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), "level", wrong.alias("errors"), F.concat(F.lit("{"), members, F.lit("}")).alias("json"))


def _quoted(text: Column) -> Column:
    """A JSON string; null for null."""
    made = F.to_json(F.struct(text.alias("x")))
    return F.when(text.isNotNull(), made.substr(F.lit(6), F.length(made) - 6))
