"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

Calls and results meet in a hash join on (conversation, call id): results are one row for each key then, so a
partition's table is its share of them, however many calls a conversation has. Calls are put in a topological order of
their dependencies: where all of a conversation's dependencies point to earlier calls, the order of the calls is one
already; other conversations of up to ``GROUP`` calls and dependencies are ordered in one pass each. In longer ones chains
of single dependencies are followed by doubling, and calls of several dependencies are released in rounds. Arguments are validated against the schema of the called
name, compiled to column expressions over a parsed variant, and records are written with sorted keys and without
spaces.

Calls that repeat a (conversation, id) are one call: the smallest by its other columns. Of several results of a
call the smallest stays. Calls of equal place in the order of dependencies follow seq (null: 0), then their id. A
dependency on an unknown call is ignored. Calls in a cycle, or behind one, come after all others and are not valid. Null
arguments or arguments that are no JSON object are not valid and written as null; a call without a result is not
linked and its result is null; results without a call and rows without a conversation or an id are left out. Other
columns are not read. No calls, no rows. A schema with a keyword that is not in ``KEYWORDS`` raises ValueError.
"""

from __future__ import annotations

import json
from collections import defaultdict
from functools import reduce
from operator import ge, gt, le, lt, or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import cut, discard

#: Schema of the calls that a plain conversation makes: a user's turn asks, the next turn answers.
ASK = {
    "ask": {"type": "object", "required": ["prompt"], "properties": {"prompt": {"type": "string", "minLength": 1}}, "additionalProperties": False}
}
#: Calls and dependencies of a conversation that one task orders, at most.
GROUP = 20_000
#: JSON type of a schema -> pattern of the variant's type; a number without a fraction is an integer.
TYPES = {
    "string": "STRING", "integer": "BIGINT|DECIMAL\\(\\d+,0\\)", "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*", "boolean": "BOOLEAN",
    "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID",
}
#: Keywords of schemas that are checked, and those that only describe.
KEYWORDS = frozenset(
    "type enum const minLength maxLength pattern minimum maximum exclusiveMinimum exclusiveMaximum minItems maxItems items "
    "required properties additionalProperties title description default examples $schema $id $comment".split()
)


def member(value: Column, name: str) -> Column:
    """The member of an object, null if there is none."""
    quote = '"' if "'" in name else "'"
    if quote in name or "\\" in name:
        raise ValueError(f"the name {name!r} cannot be a path")
    return F.try_variant_get(value, f"$[{quote}{name}{quote}]", "variant")


def conforms(value: Column, schema: dict | bool) -> Column:
    """Whether a variant is what a schema asks for; keywords for other types of values hold."""
    if isinstance(schema, bool):
        return F.lit(schema)
    if unknown := set(schema) - KEYWORDS:
        raise ValueError(f"schema keywords {sorted(unknown)} are not checked")
    kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    number = F.when(kind.rlike(f"^({TYPES['number']})$"), F.try_variant_get(value, "$", "double"))
    length = F.when(kind == "STRING", F.char_length(text))
    items = F.when(kind.rlike("^ARRAY"), F.try_variant_get(value, "$", "array<variant>"))
    count, object_ = F.when(items.isNotNull(), F.size(items)), kind.rlike("^OBJECT")
    names = F.map_keys(F.from_json(F.to_json(F.when(object_, value)), "map<string,string>"))
    holds = F.lit(True)

    def also(condition: Column) -> None:
        nonlocal holds
        holds = holds & F.coalesce(condition, F.lit(True))  # null: it is not about a value of this type

    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        holds = F.coalesce(kind.rlike(f"^({'|'.join(TYPES[k] for k in kinds)})$"), F.lit("null" in kinds))
    same = lambda one: F.coalesce(F.to_json(value), F.lit("null")) == F.to_json(F.parse_json(F.lit(json.dumps(one))))
    if "enum" in schema:
        also(reduce(or_, map(same, schema["enum"]), F.lit(False)))
    if "const" in schema:
        also(same(schema["const"]))
    for keyword, of, fits in (
        ("minLength", length, ge), ("maxLength", length, le), ("minimum", number, ge), ("maximum", number, le),
        ("exclusiveMinimum", number, gt), ("exclusiveMaximum", number, lt), ("minItems", count, ge), ("maxItems", count, le),
    ):
        if keyword in schema:
            also(F.when(of.isNotNull(), fits(of, F.lit(schema[keyword]))))
    if "pattern" in schema:
        also(F.when(kind == "STRING", text.rlike(schema["pattern"])))
    if "items" in schema:
        also(F.forall(items, lambda x: conforms(x, schema["items"])))
    for name in schema.get("required", []):
        also(F.array_contains(names, name))
    properties = schema.get("properties", {})
    if schema.get("additionalProperties") is False:
        also(F.forall(names, lambda n: n.isin(*properties)) if properties else F.when(object_, F.size(names) == 0))
    elif schema.get("additionalProperties", True) is not True:
        raise ValueError("additionalProperties is true or false")
    for name, rule in properties.items():
        also(~F.array_contains(names, name) | conforms(member(value, name), rule))
    return holds


def ordered(calls: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """conv_id, call_id, level, cyclic of one conversation: the round in which a call's dependencies are all placed."""
    after, missing = defaultdict(list), dict.fromkeys(calls.call_id, 0)
    for call, on in zip(edges.call_id, edges.on, strict=True):
        after[on].append(call)
        missing[call] += 1
    level, now = {}, [c for c, n in missing.items() if not n]
    while now:
        level |= dict.fromkeys(now, max(level.values(), default=-1) + 1)
        ready = []
        for on in now:
            for call in after[on]:
                missing[call] -= 1
                if not missing[call]:
                    ready.append(call)
        now = ready
    levels = [level.get(c, 0) for c in calls.call_id]
    return pd.DataFrame({"conv_id": calls.conv_id, "call_id": calls.call_id, "level": levels, "cyclic": [c not in level for c in calls.call_id]})


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level, cyclic: level 0 where the order of seq is topological, else the round that places the call."""
    edges = calls.select("conv_id", "call_id", "seq", F.explode(F.array_distinct("depends_on")).alias("on"))
    parents = calls.select("conv_id", F.col("call_id").alias("on"), F.col("seq").alias("seq_on"))
    edges = cut(edges.join(parents, ["conv_id", "on"]), "edges")
    mixed = edges.where("seq_on >= seq").select("conv_id").distinct()
    placed = calls.join(mixed, "conv_id", "left_anti").select("conv_id", "call_id", F.lit(0).alias("level"), F.lit(False).alias("cyclic"))
    waiting = cut(calls.join(mixed, "conv_id", "left_semi").select("conv_id", "call_id"), "waiting")
    edges = cut(edges.join(mixed, "conv_id", "left_semi").select("conv_id", "call_id", "on"), "edges")
    if waiting.isEmpty():
        return placed
    sizes = waiting.select("conv_id").unionByName(edges.select("conv_id")).groupBy("conv_id").agg(F.count("*").alias("n"))
    long = cut(sizes.where(F.col("n") > GROUP).select("conv_id"), "long")
    short = [rows.join(long, "conv_id", "left_anti").groupBy("conv_id") for rows in (waiting, edges)]
    kind = waiting.schema["conv_id"].dataType.simpleString()
    placed = placed.unionByName(short[0].cogroup(short[1]).applyInPandas(ordered, f"conv_id {kind}, call_id string, level int, cyclic boolean"))
    waiting, edges = (cut(rows.join(long, "conv_id", "left_semi"), "rounds") for rows in (waiting, edges))
    return placed if waiting.isEmpty() else placed.unionByName(long_levels(waiting, edges))


def jumped(pointers: DataFrame) -> DataFrame:
    """conv_id, call_id, to, far, moving of calls that depend on one call each: the end of a call's chain and its distance.

    Every pointer moves to where its target points, so a chain of n links takes about log2(n) rounds, in any order. A
    pointer that still moves after as many rounds as the number of pointers has bits leads into a cycle.
    """
    rounds = pointers.count().bit_length() + 1
    now = cut(pointers.withColumn("moving", F.lit(True)), "jumps")
    for _ in range(rounds):
        onward = now.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"))
        step = (F.coalesce("next", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("next").isNotNull().alias("moving"))
        new = cut(now.join(onward, ["conv_id", "to"], "left").select("conv_id", "call_id", *step), "jumps")
        discard(now)
        now = new
        if now.where("moving").isEmpty():
            break
    return now


def long_levels(waiting: DataFrame, edges: DataFrame) -> DataFrame:
    """The levels of conversations that no task orders as a whole.

    Chains of calls that depend on one call each are followed to their ends at once (``jumped``). What is left are calls
    of several dependencies, each a longest way from calls whose levels are known: a round for each such call on it.
    """
    key = ["conv_id", "call_id"]
    counts = edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("on").alias("to"))
    chains = jumped(counts.where("n = 1").select(*key, "to", F.lit(1).cast("long").alias("far")))
    ends = chains.select("conv_id", F.col("call_id").alias("on"), "to", "far")
    arcs = edges.join(counts.where("n > 1").select(*key), key, "left_semi").join(ends, ["conv_id", "on"], "left")
    arcs = arcs.select(*key, F.coalesce("to", "on").alias("to"), (F.coalesce("far", F.lit(0)) + 1).alias("way"))
    new = cut(waiting.join(edges, key, "left_anti").select(*key, F.lit(0).cast("long").alias("level")), "level")
    known, kept = [new], None
    while not new.isEmpty():
        reached = new.select("conv_id", F.col("call_id").alias("to"), "level")
        met = arcs.join(reached, ["conv_id", "to"], "left").select(
            *key, F.when(F.col("level").isNull(), F.col("to")).alias("to"), (F.col("way") + F.coalesce("level", F.lit(0))).alias("way")
        )
        before, kept = kept, cut(met.groupBy(*key, "to").agg(F.max("way").alias("way")), "arcs")  # a null to: the longest way so far
        if before is not None:
            discard(before)
        states = kept.groupBy(*key).agg(F.count("to").alias("open"), F.max("way").alias("level"))
        new = cut(states.where("open = 0").select(*key, "level"), "level")
        known.append(new)
        arcs = kept.join(new, key, "left_anti")
    ends = reduce(DataFrame.unionByName, known)
    ways = chains.where("NOT moving").join(ends.select("conv_id", F.col("call_id").alias("to"), "level"), ["conv_id", "to"])
    every = ends.unionByName(ways.select(*key, (F.col("level") + F.col("far")).alias("level")))
    found = waiting.join(every, key, "left")
    return found.select(*key, F.coalesce("level", F.lit(0)).cast("int").alias("level"), F.col("level").isNull().alias("cyclic"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conv_id, call_id, position, linked, valid, json of every call.

    calls: conv_id, call_id, seq, name, arguments (JSON text), depends_on (array of call ids); results: conv_id,
    call_id, content. position counts the calls of a conversation from 0 in topological order.
    """
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    one = F.struct(
        F.coalesce("seq", F.lit(0)).alias("seq"), "name", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on")
    )
    calls = calls.where(known).groupBy("conv_id", "call_id").agg(F.min(one).alias("c")).select("conv_id", "call_id", "c.*")
    results = results.where(known).groupBy("conv_id", "call_id").agg(F.min("content").alias("content"), F.count("*").alias("results"))
    calls = cut(calls, "calls")
    placed = calls.select("conv_id", "call_id", "seq").join(levels(calls), ["conv_id", "call_id"])
    # Places in a conversation: counts of its parts first, so that a long conversation is no single task's.
    placed = cut(placed.withColumn("part", F.floor(F.col("seq") / 256)), "ordered")
    cell = ["conv_id", "cyclic", "level", "part"]
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy(*cell[1:]).rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy(*cell).agg(F.count("*").alias("n")).select(*cell, F.coalesce(before, F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy(*cell).orderBy("seq", "call_id")) - 1
    position = (F.col("local") + F.col("before")).alias("position")
    places = placed.withColumn("local", local).join(starts, cell).select("conv_id", "call_id", "cyclic", position)

    parsed = F.try_parse_json("arguments")
    valid = F.lit(False)
    for name, schema in schemas.items():
        fits = F.schema_of_variant(F.col("parsed")).rlike("^OBJECT") & conforms(F.col("parsed"), schema)
        valid = F.when(F.col("name") == name, F.coalesce(fits, F.lit(False))).otherwise(valid)
    linked = calls.join(results.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(places, ["conv_id", "call_id"])
    linked = linked.withColumn("parsed", parsed).withColumn("linked", F.col("results").isNotNull())
    record = F.struct(F.col("parsed").alias("arguments"), F.col("call_id").alias("id"), "name", "position", F.col("content").alias("result"))
    written = F.to_json(record, {"ignoreNullFields": "false"}).alias("json")
    return linked.select("conv_id", "call_id", "position", "linked", (valid & ~F.col("cyclic")).alias("valid"), written)


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A conversation's turns as calls and results: a user's turn asks, an assistant's answers the turn before it.

    The id of a call is its turn; a call depends on that of two turns before. A null text leaves the arguments without
    a prompt. Turns of other roles, and answers to no user's turn, are no calls and give no rows.
    """
    kinds = {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}
    rows = conversations.select(*(F.col(c).cast(t) for c, t in kinds.items())).where("conv_id IS NOT NULL AND turn IS NOT NULL")
    call_id = lambda turn: F.concat(F.lit("t"), turn.cast("string"))
    asks = rows.where("role = 'user'").select(
        "conv_id", call_id(F.col("turn")).alias("call_id"), F.col("turn").alias("seq"), F.lit("ask").alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"))).alias("arguments"), F.array(call_id(F.col("turn") - 2)).alias("depends_on"),
    )
    answers = rows.where("role = 'assistant'").select("conv_id", call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return asks, answers
