"""Tool calls linked to their results, ordered, validated and written as canonical JSON.

DataFrame functions only: no Python runs on executors.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tidemark.plans.staging import drop, staged

#: What ``schema_of_variant`` may say for each JSON type of a schema.
JSON_TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$", "boolean": "^BOOLEAN$", "array": "^ARRAY<.*", "object": "^OBJECT<.*"}
#: Numbers and what stands between them, outside of strings.
_NUMBERS = "-?[0-9]+(?:\\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|[^0-9-]+"


class Field(NamedTuple):
    """An argument: its name, or the names on the way to it; its JSON type; whether it must be there;
    the values it may have; the least and greatest number; the JSON type of an array's elements."""

    name: str | tuple[str, ...]
    kind: str
    required: bool = True
    choices: tuple | None = None
    least: float | None = None
    most: float | None = None
    items: str | None = None

    def path(self) -> tuple[str, ...]:
        return (self.name,) if isinstance(self.name, str) else self.name


#: Arguments of each tool, as :class:`Field` or its first three values. The call that asks for a reply
#: is the one that a conversation without tools implies.
REPLY_SCHEMA = {"reply": [("text", "string", True), ("turn", "integer", True)]}


def _number(token: Column) -> Column:
    """One spelling for a JSON number: whole ones below 2^53 in digits, others as a double's."""
    value = token.cast("double")
    whole = (value == F.floor(value)) & (F.abs(value) < 2.0**53)
    said = F.when(whole, value.cast("long").cast("string")).when(F.abs(value) == float("inf"), token).otherwise(value.cast("string"))
    return F.when(token == "-0", F.lit("0")).when(token.rlike("^-?[0-9]+$"), token).otherwise(said)


def canonical_numbers(text: Column) -> Column:
    """Valid JSON text with every number in one spelling: ``1e2``, ``100.0`` and ``100`` are ``100``."""
    quote, slash = "\x01", "\x02"  # valid JSON holds none of these
    plain = F.replace(F.replace(text, F.lit("\\\\"), F.lit(slash)), F.lit('\\"'), F.lit(quote))
    outside = lambda piece: F.array_join(F.transform(F.regexp_extract_all(piece, F.lit(_NUMBERS), F.lit(0)), lambda x: F.when(x.rlike("^-?[0-9]"), _number(x)).otherwise(x)), "")
    pieces = F.transform(F.split(plain, '"'), lambda piece, i: F.when(i % 2 == 0, outside(piece)).otherwise(piece))
    back = F.replace(F.replace(F.array_join(pieces, '"'), F.lit(quote), F.lit('\\"')), F.lit(slash), F.lit("\\\\"))
    return F.when(text.rlike("[0-9][.eE]|-0"), back).otherwise(text)


def _problems(arguments: Column, fields: list[Field], closed: bool) -> Column:
    """Names of the fields that are required and absent, or not as their field says; of a closed tool
    also those that no field names, with ``+`` before them."""
    found = []
    for field in map(lambda f: Field(*f), fields):
        path = "$" + "".join(f"['{p}']" for p in field.path())
        value, name = F.try_variant_get(arguments, path, "variant"), F.lit(".".join(field.path()))
        good = F.schema_of_variant(value).rlike(JSON_TYPES[field.kind])
        if field.choices is not None:
            good = good & F.to_json(value).isin([json.dumps(c, ensure_ascii=False) for c in field.choices])
        if field.least is not None or field.most is not None:
            number = F.try_variant_get(arguments, path, "double")
            good = good & F.coalesce((number >= (field.least if field.least is not None else float("-inf"))) & (number <= (field.most if field.most is not None else float("inf"))), F.lit(False))
        if field.items is not None:
            inside = JSON_TYPES[field.items].strip("^$").removesuffix(".*")
            good = good & F.schema_of_variant(value).rlike(f"^ARRAY<(VOID>$|{inside})")
        absent = value.isNull() | F.is_variant_null(value)
        found.append(F.when(absent, name if field.required else F.lit(None)).when(~good, name))
    known = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    if not closed:
        return known
    named = F.array(*[F.lit(p) for p in sorted({Field(*f).path()[0] for f in fields})]).cast("array<string>")
    return F.concat(known, F.transform(F.array_sort(F.array_except(F.json_object_keys(F.to_json(arguments)), named)), lambda k: F.concat(F.lit("+"), k)))


def _levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, depth of calls with several parents: the longest way from a call that follows
    none, by taking away what waits for nothing round by round; null in and after a cycle. There are
    as many rounds as levels, and each works on what is left."""
    key, spark = ["conv_id", "call_id"], calls.sparkSession
    names = calls.select("conv_id", F.col("call_id").alias("parent_id"))
    edges = calls.select(*key, F.explode("parent_id").alias("parent_id")).distinct().join(names, ["conv_id", "parent_id"])
    edges, left = staged(edges.select(*key, "parent_id"), "edges", old := []), staged(calls.select(*key), "left", old)
    found, kept, depth = None, [], 0
    while True:
        ready = staged(left.join(edges, key, "left_anti").withColumn("depth", F.lit(depth).cast("long")), "ready", kept)
        found = ready if found is None else found.unionByName(ready)
        if ready.isEmpty():
            break
        gone = ready.select("conv_id", F.col("call_id").alias("parent_id"))
        edges, left = staged(edges.join(gone, ["conv_id", "parent_id"], "left_anti").select(*key, "parent_id"), "edges", new := []), staged(left.join(ready, key, "left_anti"), "left", new)
        drop(spark, old)
        old, depth = new, depth + 1
    told = staged(found.unionByName(left.withColumn("depth", F.lit(None).cast("long"))), "depths")
    drop(spark, kept)
    drop(spark, old)
    return told


def _depths(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, depth: calls on the way to the one that follows nothing, by doubling
    the step up each round; null on and above a cycle."""
    key = ["conv_id", "call_id"]
    parents = calls.select("conv_id", F.col("call_id").alias("parent_id"), F.lit(True).alias("known"))
    at = calls.join(parents, ["conv_id", "parent_id"], "left").select(*key, F.expr("if(known, parent_id, null)").alias("up"), F.expr("if(known, 1L, 0L)").alias("depth"))
    spark, old = calls.sparkSession, []
    at, left = staged(at, "depths", old), None
    # Each round settles all calls of twice the depth, so where none was settled the rest is cyclic.
    while (now := at.where("up is not null").count()) and now != left:
        above = at.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        new: list[str] = []
        at = staged(at.join(above, ["conv_id", "up"], "left").select(*key, F.col("further").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "depths", new)
        drop(spark, old)
        old, left = new, now
    return at.select(*key, F.expr("if(up is null, depth, null)").alias("depth"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, list[Field]], closed: frozenset[str] = frozenset()) -> DataFrame:
    """A row for each call of ``calls`` (conv_id, call_id, parent_id, name, arguments as JSON)
    with its result from ``results`` (conv_id, call_id, content): conv_id, call_id, depth, name,
    n_calls, n_results, linked, valid, problems, json.

    depth orders a conversation's calls topologically: a call follows ``parent_id``, whose
    result it uses, or all of an array ``parent_id``, and everything with a smaller depth may stand
    before it. An unknown parent counts as none; the depth of calls in a cycle or after one is null.
    problems lists what the tool's schema (:class:`Field`, also of nested arguments) does not allow,
    and for tools in ``closed`` the arguments it does not name, or ``arguments`` if they are no JSON
    object, or ``name`` for an unknown tool. json holds the linked call with keys in order, no white
    space and one spelling for each number; arguments that are no JSON stand there as null.

    A repeated (conv_id, call_id) keeps the smallest name, arguments and parent, and the
    smallest content; n_calls and n_results tell how many there were. Rows without conv_id or
    call_id, and results without a call, are left out.
    """
    key = ["conv_id", "call_id"]
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    one = calls.where(named).groupBy(*key).agg(F.min(F.struct("name", "arguments", "parent_id")).alias("c"), F.count("*").alias("n_calls")).select(*key, "c.*", "n_calls")
    one = staged(one, "calls")
    answer = results.where(named).groupBy(*key).agg(F.min("content").alias("content"), F.count("*").alias("n_results"))
    depths = _levels(one) if isinstance(one.schema["parent_id"].dataType, ArrayType) else _depths(one)
    said = F.when(F.try_parse_json("arguments").isNotNull(), canonical_numbers(F.col("arguments")))
    joined = one.join(answer.hint("shuffle_hash"), key, "left").join(depths, key, "left").withColumn("args", F.try_parse_json(said))
    is_object = F.coalesce(F.schema_of_variant("args").startswith("OBJECT<"), F.lit(False))
    problems = F.array(F.lit("name"))
    for name, fields in schemas.items():
        problems = F.when(F.col("name") == name, F.when(is_object, _problems(F.col("args"), fields, name in closed)).otherwise(F.array(F.lit("arguments")))).otherwise(problems)
    said = F.to_json(F.struct(F.col("args").alias("arguments"), "call_id", "conv_id", "depth", "name", "parent_id", F.col("content").alias("result")), {"ignoreNullFields": "false"})
    return joined.select(*key, "depth", "name", "n_calls", F.coalesce("n_results", F.lit(0)).alias("n_results"), F.col("n_results").isNotNull().alias("linked"), problems.alias("problems"), said.alias("json")).withColumn("valid", F.size("problems") == 0)


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that ``conversations`` (conv_id, turn, role, text) imply: each user
    turn calls ``reply`` with its text and follows the user turn two before; the assistant turn
    next to it is the result."""
    name = lambda turn: F.concat_ws(":", "conv_id", turn)
    turn = F.col("turn")
    calls = conversations.where("role = 'user'").select("conv_id", name(turn).alias("call_id"), name(turn - 2).alias("parent_id"), F.lit("reply").alias("name"), F.to_json(F.struct("text", "turn")).alias("arguments"))
    return calls, conversations.where("role = 'assistant'").select("conv_id", name(turn - 1).alias("call_id"), F.col("text").alias("content"))
