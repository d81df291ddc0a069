"""Tool calls of conversations: linked to results, ordered, validated, serialised.

Calls and results are brought to one row for each conversation and identifier,
so repeats cannot multiply, and hash-joined. A call's level is one above the
highest level of the calls it depends on, as Kahn's algorithm finds it: within
one expression for conversations of at most ``TOGETHER`` calls, in relational
rounds, one for each level, for those that have more. Arguments are checked
against a schema for each tool. Each link is written as JSON with sorted keys.
All steps are DataFrame operations; no step gathers a larger conversation.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import discard, materialise

KEY = ["conversation", "call_id"]
TOGETHER = 32
#: JSON type -> types that schema_of_variant names.
TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT.*", "array": "^ARRAY.*"}


def canonical_json(text: Column) -> Column:
    """JSON with keys sorted at every level and no blanks; null where the text isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def parse_messages(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The calls and the results written as JSON in messages.

    A call stands in ``{"tool_calls": [{"id", "name", "arguments", "depends_on"}]}``,
    a result is ``{"tool_call_id", "content"}``. Other messages, null and empty
    texts and what isn't JSON have neither; texts are parsed whole. A call
    without an id is left out, a null conversation or turn stays null. Repeated
    messages give repeated rows, other columns aren't read.
    """
    v = F.try_parse_json(F.when(F.col(text_col).rlike(r"^\s*\{"), F.col(text_col)))
    rows = messages.select(F.col(conv_col).cast("string").alias("conversation"), F.col(turn_col).cast("long").alias("turn"), v.alias("v"))
    text = lambda c, path: F.try_variant_get(c, path, "string")
    each = rows.select("conversation", "turn", F.explode(F.try_variant_get("v", "$.tool_calls", "array<variant>")).alias("c"))
    calls = each.select("conversation", "turn", text(F.col("c"), "$.id").alias("call_id"), text(F.col("c"), "$.name").alias("name"), F.to_json(F.try_variant_get(F.col("c"), "$.arguments", "variant")).alias("arguments"), F.coalesce(F.try_variant_get(F.col("c"), "$.depends_on", "array<string>"), F.array().cast("array<string>")).alias("depends_on"))
    results = rows.where(text(F.col("v"), "$.tool_call_id").isNotNull()).select("conversation", "turn", text(F.col("v"), "$.tool_call_id").alias("call_id"), text(F.col("v"), "$.content").alias("content"))
    return calls.where(F.col("call_id").isNotNull()), results


def dialogue_calls(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Plain dialogue as calls and results.

    A user turn calls ``reply`` and a system turn ``context``, with the text and
    the turn as arguments; the assistant turn that follows is the result. Turn 0
    is what later calls of its conversation depend on. Any other role is read
    like the assistant's. A null conversation, turn or role is named ``none``.
    """
    conv = F.coalesce(F.col(conv_col).cast("string"), F.lit("none"))
    turn = F.col(turn_col).cast("long")
    name = lambda t: F.concat(conv, F.lit("-"), F.coalesce(t.cast("string"), F.lit("none")))
    role = F.coalesce(F.col(role_col), F.lit("none"))
    asks = role.isin("user", "system")
    arguments = F.to_json(F.struct(F.col(text_col).cast("string").alias("text"), turn.alias("turn")))
    base = [conv.alias("conversation"), turn.alias("turn")]
    calls = conversations.where(asks).select(*base, name(turn).alias("call_id"), F.when(role == "user", "reply").otherwise("context").alias("name"), arguments.alias("arguments"), F.when(turn > 0, F.array(name(F.lit(0)))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    results = conversations.where(~asks).select(*base, name(turn - 1).alias("call_id"), F.col(text_col).cast("string").alias("content"))
    return calls, results


def argument_errors(name: Column, arguments: Column, schemas: Mapping[str, Mapping[str, tuple[str, bool]]]) -> Column:
    """Comma-joined errors of a call's arguments (a JSON text), empty if there are none.

    schemas: tool -> argument -> (JSON type, required). Errors: unknown-tool,
    malformed, missing:x, type:x, unknown:x, in the schema's order.
    """
    v = F.try_parse_json(arguments)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    out = F.lit("unknown-tool")
    for tool, schema in schemas.items():
        checks = []
        for arg, (json_type, required) in schema.items():
            got = kind(f"$['{arg}']")
            absent = F.try_variant_get(v, f"$['{arg}']", "variant").isNull() | (got == "VOID")
            checks.append(F.when(absent, F.lit(f"missing:{arg}") if required else F.lit(None).cast("string")).when(~got.rlike(TYPES[json_type]), f"type:{arg}"))
        extra = F.transform(F.array_sort(F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, schema)))), lambda k: F.concat(F.lit("unknown:"), k))
        errors = F.array_join(F.concat(F.array_compact(F.array(*checks)), F.coalesce(extra, F.array().cast("array<string>"))), ",")
        out = F.when(name == tool, F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "malformed").otherwise(errors)).otherwise(out)
    return out


def _levels_together(calls: DataFrame) -> DataFrame:
    """Levels of conversations of at most TOGETHER calls, each in one row."""
    cell = F.struct("call_id", F.array_distinct("depends_on").alias("needs"), F.when(F.size("depends_on") == 0, 0).cast("int").alias("level"))
    one = calls.groupBy("conversation").agg(F.collect_list(cell).alias("calls"))

    def settle(acc: Column, _: Column) -> Column:
        level = lambda need: F.get(F.filter(acc, lambda c: c["call_id"] == need), F.lit(0))["level"]

        def met(c: Column) -> Column:
            levels = F.transform(c["needs"], level)
            return F.struct(c["call_id"], c["needs"], F.when(c["level"].isNotNull(), c["level"]).when(F.forall(levels, lambda x: x.isNotNull()), F.array_max(levels) + 1).alias("level"))

        return F.transform(acc, met)

    done = F.aggregate(F.sequence(F.lit(1), F.size("calls")), F.col("calls"), settle)
    return one.select("conversation", F.explode(done).alias("c")).select("conversation", "c.call_id", "c.level")


def _levels_by_rounds(calls: DataFrame) -> DataFrame:
    """Levels of larger conversations: each round handles the edges still open."""
    edges = calls.select(*KEY, F.explode(F.array_distinct("depends_on")).alias("needs"))
    free = calls.where(F.size("depends_on") == 0).select(*KEY, F.lit(0).alias("level"))
    if edges.isEmpty():
        return free
    open_, levels, level = materialise(edges, "edges"), [materialise(free, "levels")], 0
    newest = levels[0]
    while True:
        met = newest.select("conversation", F.col("call_id").alias("needs"), F.lit(True).alias("met"))
        left = materialise(open_.join(met, ["conversation", "needs"], "left").select(*KEY, "needs", F.col("met").isNotNull().alias("met")), "edges")
        waiting = left.groupBy(*KEY).agg(F.bool_and("met").alias("done"))
        level += 1
        newest = materialise(waiting.where("done").select(*KEY, F.lit(level).alias("level")), "levels")
        if newest.isEmpty():
            break
        levels.append(newest)
        # met edges are settled, so a call is released once, when its last ones are met
        still = materialise(left.where("NOT met").select(*KEY, "needs"), "edges")
        discard(open_, left)
        open_ = still
        if open_.isEmpty():
            break
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def call_levels(calls: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(conversation, call_id, level) of each call; null, or no row, where a dependency is missing or part of a circle.

    calls has one row for each key, with depends_on. A null conversation's calls have none.
    """
    sizes = calls.groupBy("conversation").agg((F.count("*") > together).alias("large"))
    sized = materialise(calls.join(sizes.hint("shuffle_hash"), "conversation").select(*KEY, "depends_on", "large"), "calls")
    small = _levels_together(sized.where("NOT large"))
    large = sized.where("large")
    return small if large.isEmpty() else small.unionByName(_levels_by_rounds(large))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, tuple[str, bool]]]) -> DataFrame:
    """One row for each conversation and identifier: conversation, call_id, status, name, call_turn, result_turn, n_calls, n_results, level, errors, valid, json.

    Of several calls or results with one identifier the one of the earliest turn
    counts (then the least text); the numbers tell how many there were. status:
    linked, no-result, no-call, early-result (before its call). ``level`` orders
    the links: dependencies have lower ones; null where they are missing or
    circular. Empty tables give no rows.
    """
    first = lambda *c: F.min(F.struct(*c))
    asked = calls.groupBy(*KEY).agg(first("turn", "name", "arguments", "depends_on").alias("c"), F.count("*").alias("n_calls")).select(*KEY, "c.*", "n_calls")
    given = results.groupBy(*KEY).agg(first("turn", "content").alias("r"), F.count("*").alias("n_results")).select(*KEY, F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), "n_results")
    levels = call_levels(asked.select(*KEY, "depends_on"))
    both = asked.withColumnRenamed("turn", "call_turn").join(levels.hint("shuffle_hash"), KEY, "left").join(given.hint("shuffle_hash"), KEY, "full")
    status = F.when(F.col("n_calls").isNull(), "no-call").when(F.col("n_results").isNull(), "no-result").when(F.col("result_turn") < F.col("call_turn"), "early-result").otherwise("linked")
    errors = F.when(F.col("n_calls").isNull(), "").otherwise(argument_errors(F.col("name"), F.col("arguments"), schemas))
    out = both.withColumns({"status": status, "errors": errors})
    link = F.to_json(F.struct(F.col("arguments").alias("arguments"), F.col("content").alias("content"), F.col("depends_on").alias("depends_on"), F.col("call_id").alias("id"), F.col("level").alias("level"), F.col("name").alias("name"), "status"))
    # the arguments are JSON themselves: parsed, they become part of the object
    with_arguments = F.when(F.try_parse_json("arguments").isNull(), link).otherwise(F.concat(F.lit('{"arguments":'), F.col("arguments"), F.lit(","), F.substring(F.to_json(F.struct(F.col("content").alias("content"), F.col("depends_on").alias("depends_on"), F.col("call_id").alias("id"), F.col("level").alias("level"), F.col("name").alias("name"), "status")), 2, 1 << 30)))
    return out.select(
        *KEY, "status", "name", "call_turn", "result_turn", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), F.col("level").cast("long").alias("level"), "errors", (F.col("n_calls").isNotNull() & (F.col("errors") == "")).alias("valid"), canonical_json(with_arguments).alias("json")
    )
