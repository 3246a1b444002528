"""Chat formatting: tool calls linked to results, ordered, validated, and written as canonical JSON.

A message's text may be plain, or JSON of one of two forms (keys beyond these are kept in the JSON):

* a call message, role ``assistant``: ``{"tool_calls": [{"id": ..., "name": ..., "arguments": {...}}, ...]}``
* a result message, role ``tool``: ``{"tool_call_id": ..., "content": ...}``

``arguments`` may be an object or a string that holds one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pestle.llm.common import shuffle_partitions, written

CALL = "array<struct<id:string,name:string,arguments:string>>"


def canonical(value):
    """Canonical JSON of a variant: no spaces, keys in order of their UTF-16 code units (as in RFC 8785), decimals
    without trailing zeros (1.0 is 1), numbers with an exponent as doubles (1e0 is 1.0)."""
    return F.to_json(value)


def parse(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    m = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    looks = F.col("text").rlike(r"^\s*\{") & F.col("role").isin("assistant", "tool")
    m = m.withColumn("v", F.try_parse_json(F.when(looks, F.col("text"))))
    calls = F.from_json(F.get_json_object(F.when((F.col("role") == "assistant") & F.col("v").isNotNull(), F.col("text")), "$.tool_calls"), CALL)
    m = m.withColumn("calls", F.filter(F.coalesce(calls, F.array().cast(CALL)), lambda c: c.isNotNull()))
    return m.withColumn("result_of", F.when(F.col("role") == "tool", F.try_variant_get("v", "$.tool_call_id", "string")))


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Calls with their errors: ``row, at, errors``.

    ``schemas`` has one row per parameter: ``tool, param, type, required``, with ``type`` one of string,
    integer, number, boolean, object, array; a tool without parameters has one row with a null param.
    """
    spark = calls.sparkSession
    args = calls.select("row", "at", "tool", F.try_parse_json("arguments").alias("args"))
    bad = args.filter(F.col("args").isNull() | ~F.schema_of_variant("args").startswith("OBJECT")).select("row", "at", F.lit("arguments: not an object").alias("error"))
    tools = schemas.select("tool").distinct()
    unknown = calls.join(tools.hint("shuffle_hash"), "tool", "left_anti").select("row", "at", F.concat(F.lit("tool: unknown "), F.coalesce("tool", F.lit("null"))).alias("error"))
    known = args.join(tools.hint("shuffle_hash"), "tool", "left_semi").filter("args IS NOT NULL")
    known = known.filter(F.schema_of_variant("args").startswith("OBJECT"))
    given = known.lateralJoin(spark.tvf.variant_explode(F.col("args").outer()))
    given = given.select("row", "at", "tool", F.col("key").alias("param"), F.schema_of_variant("value").alias("got"))
    params = schemas.filter("param IS NOT NULL").select("tool", "param", "type", F.coalesce("required", F.lit(False)).alias("required"))
    typed = given.join(params.hint("shuffle_hash"), ["tool", "param"], "left")
    got = F.col("got")
    integer, number = got == "BIGINT", got.rlike("^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$")
    ok = F.expr("CASE type WHEN 'string' THEN got = 'STRING' WHEN 'boolean' THEN got = 'BOOLEAN' END")
    ok = F.coalesce(ok, F.when(F.col("type") == "integer", integer), F.when(F.col("type") == "number", number), F.when(F.col("type") == "object", got.startswith("OBJECT")), F.when(F.col("type") == "array", got.startswith("ARRAY")))
    wrong = typed.select("row", "at", F.when(F.col("type").isNull(), F.concat("param", F.lit(": not in the schema"))).when(~ok, F.concat("param", F.lit(": not of type "), "type")).alias("error")).filter("error IS NOT NULL")
    needed = known.select("row", "at", "tool").join(params.filter("required").hint("shuffle_hash"), "tool")
    missing = needed.join(given.select("row", "at", "param"), ["row", "at", "param"], "left_anti").select("row", "at", F.concat("param", F.lit(": missing")).alias("error"))
    every = bad.unionByName(unknown).unionByName(wrong).unionByName(missing)
    return every.groupBy("row", "at").agg(F.array_sort(F.collect_set("error")).alias("errors"))


def format_chat(messages: DataFrame, schemas: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message, in an order where each linked result follows its call.

    Returns ``conv, turn, role, position, n_calls, call_id, link, call_turn, n_errors, errors, json``.

    * ``link``: of a result, ``linked``, ``orphan`` (no such call in the conversation) or ``repeated``
      (a later result of the same call); of a call message, ``answered`` or ``open``; else null. Calls
      and results meet in a hash join on (conversation, identifier); of calls that repeat an identifier
      the first is linked.
    * ``position``: from 0 in each conversation, by turn, except that a linked result that comes before its
      call moves behind it: a topological order of turn order and call-result edges.
    * ``errors``: of the message's calls, against ``schemas`` (see :func:`argument_errors`); none without.
    * ``json``: canonical JSON of role and content, or of role and the parsed object.

    Null text is content null; a null role, turn or conversation stays null (nulls sort first and form a
    conversation of their own); ties in turn are ordered by role, text and read order; repeated rows stay;
    an empty table gives no rows; texts of any length are kept whole; further columns are ignored. No conversation is gathered in one task:
    positions come from a range partitioning and prefix counts.
    """
    m = written(parse(messages, conv, turn, role, text), "messages")
    calls = m.select("conv", "turn", "row", F.posexplode("calls").alias("at", "c"))
    calls = calls.select("conv", "turn", "row", "at", F.col("c.id").alias("call"), F.col("c.name").alias("tool"), F.col("c.arguments").alias("arguments"))
    named = calls.filter("call IS NOT NULL").groupBy("conv", "call").agg(F.min(F.struct("turn", "row", "at")).alias("c"))
    named = named.select(F.col("conv").alias("c_conv"), "call", F.col("c.turn").alias("call_turn"), F.col("c.row").alias("call_row"), F.col("c.at").alias("call_at"))
    results = m.filter("result_of IS NOT NULL").select("conv", "turn", "row", F.col("result_of").alias("call"))
    linked = results.join(named.hint("shuffle_hash"), (results["conv"].eqNullSafe(named["c_conv"])) & (results["call"] == named["call"])).select(results["conv"], "turn", "row", "call_row", "call_at", "call_turn")
    first = linked.groupBy("call_row", "call_at").agg(F.min(F.struct("turn", "row")).alias("f"))
    linked = linked.join(first.select("call_row", "call_at", F.col("f.row").alias("first_row")), ["call_row", "call_at"])
    answers = linked.select("row", "call_turn", "call_row", "call_at", (F.col("row") == F.col("first_row")).alias("is_first"))
    answered = linked.groupBy(F.col("call_row").alias("row")).agg(F.lit(True).alias("has_answer"))

    errors = None
    if schemas is not None:
        per_call = argument_errors(calls, schemas)
        each = per_call.select("row", F.explode("errors").alias("e"))
        errors = each.groupBy("row").agg(F.array_sort(F.collect_list("e")).alias("errors"))
    else:
        errors = m.sparkSession.createDataFrame([], "row long, errors array<string>")

    out = m.join(answers, "row", "left").join(answered, "row", "left").join(errors, "row", "left")
    late = F.coalesce(F.col("call_turn") >= F.col("turn"), F.lit(False)) & (F.col("call_row") != F.col("row"))
    out = out.withColumn("k_turn", F.when(late, F.col("call_turn")).otherwise(F.col("turn")))
    out = out.withColumn("k_late", late.cast("int"))
    order = ["conv", "k_turn", "k_late", "role", "text", "row"]
    content = F.to_json(F.struct(F.col("text").alias("content"), F.col("role").alias("role")), {"ignoreNullFields": "false"})
    role_field = F.expr("substr(role_json, 2)")  # "role":...}
    parsed = F.concat(F.lit('{"message":'), canonical(F.col("v")), F.lit(","), role_field)
    structured = (F.size("calls") > 0) | F.col("result_of").isNotNull()
    out = out.withColumn("role_json", F.to_json(F.struct("role"), {"ignoreNullFields": "false"}))
    out = out.withColumn("json", F.when(structured, parsed).otherwise(content))

    keys = out.select(*order, "turn", F.size("calls").alias("n_calls"), "result_of", "call_turn", "is_first", "has_answer", "errors", "json")
    n = shuffle_partitions(m.sparkSession)
    placed = written(keys.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "placed")
    counts = placed.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # at most one row per range partition
    bases = counts.select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = bases.filter("base > 0").select(F.col("conv").alias("b_conv"), F.col("part").alias("b_part"), "base")  # conversations cut by a range bound: fewer than partitions
    local = W.partitionBy("part", "conv").orderBy(*order[1:])
    placed = placed.withColumn("local", F.row_number().over(local) - 1)
    placed = placed.join(F.broadcast(bases), placed["conv"].eqNullSafe(bases["b_conv"]) & (placed["part"] == bases["b_part"]), "left")
    link = (
        F.when(F.col("result_of").isNotNull(), F.when(F.col("is_first"), "linked").when(F.col("is_first").isNotNull(), "repeated").otherwise("orphan"))
        .when(F.col("n_calls") > 0, F.when(F.col("has_answer"), "answered").otherwise("open"))
    )
    no_errors = F.array().cast("array<string>")
    return placed.select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role),
        (F.coalesce("base", F.lit(0)) + F.col("local")).cast("long").alias("position"),
        F.col("n_calls").cast("long").alias("n_calls"), F.col("result_of").alias("call_id"), link.alias("link"), "call_turn",
        F.size(F.coalesce("errors", no_errors)).cast("long").alias("n_errors"), F.coalesce("errors", no_errors).alias("errors"), "json",
    )
