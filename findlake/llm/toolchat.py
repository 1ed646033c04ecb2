"""Chat formatting with linked tool calls, in DataFrame functions only.

Calls and results meet in a hash join by identifier, calls are ordered
topologically by what they depend on, arguments are validated against the
tool's schema, and every record is one line of canonical JSON (sorted keys, no
spaces; arguments go through VARIANT, whose objects are sorted by key).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findlake.llm.common import ranked_within, stored

#: Levels of what has no place among the calls: plain messages come first; circular calls and loose results last.
_FIRST, _CIRCULAR, _LOOSE = -1, 1 << 29, 1 << 30


@dataclass(frozen=True)
class Param:
    """One argument: ``kind`` is string, integer, number or boolean."""

    kind: str
    required: bool = False
    least: float | None = None
    most: float | None = None
    among: tuple[str, ...] = ()


_KINDS = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
          "boolean": "^BOOLEAN$"}


def _argument_errors(args: Column, params: dict[str, Param]) -> list[Column]:
    out = []
    for name, p in sorted(params.items()):
        value = F.variant_get(args, f"$.{name}", "variant")
        kind = F.schema_of_variant(value)
        absent = value.isNull()
        wrong = ~absent & ~F.coalesce(kind.rlike(_KINDS[p.kind]), F.lit(False))
        fits = ~absent & ~wrong
        if p.required:
            out.append(F.when(absent, F.lit(f"missing:{name}")))
        out.append(F.when(wrong, F.lit(f"type:{name}")))
        if p.least is not None or p.most is not None:
            number = F.try_variant_get(args, f"$.{name}", "double")
            outside = F.lit(False)
            if p.least is not None:
                outside = outside | (number < p.least)
            if p.most is not None:
                outside = outside | (number > p.most)
            out.append(F.when(fits & outside, F.lit(f"range:{name}")))
        if p.among:
            out.append(F.when(fits & ~F.try_variant_get(args, f"$.{name}", "string").isin(*p.among),
                              F.lit(f"enum:{name}")))
    return out


def argument_errors(tool: str, arguments: str, schemas: dict[str, dict[str, Param]]) -> Column:
    """Sorted violations of column ``arguments`` (JSON) against the schema of column ``tool``; empty: valid.

    Null, malformed or repeated-key JSON and JSON that is no object give ``not_object``.
    """
    args = F.try_parse_json(arguments)
    errors = F.array(F.lit("unknown_tool"))
    for name, params in schemas.items():
        known = F.array(*[F.lit(k) for k in params]).cast("array<string>")
        extra = F.transform(F.array_except(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), known),
                            lambda k: F.concat(F.lit("unknown:"), k))
        found = F.filter(F.array(F.lit(None).cast("string"), *_argument_errors(args, params)), lambda x: x.isNotNull())
        errors = F.when(F.col(tool) == name, F.array_sort(F.concat(found, extra))).otherwise(errors)
    is_object = F.coalesce(F.schema_of_variant(args).startswith("OBJECT"), F.lit(False))
    return F.when(~is_object, F.array(F.lit("not_object"))).otherwise(errors)


def topological_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, n_missing) of distinct calls (conv_id, call_id, depends_on array<string>).

    Level 0 depends on no call of its conversation, level k on one of level
    k - 1 and none beyond; calls in or behind a cycle have a null level.
    ``n_missing`` counts dependencies that are not calls. Each round takes all
    calls whose dependencies are done, so there are as many rounds as levels.
    """
    ids = calls.select("conv_id", "call_id")
    edges = calls.select("conv_id", "call_id", F.explode(F.array_distinct("depends_on")).alias("dep"))
    edges = edges.join(ids.select(F.col("conv_id").alias("c"), F.col("call_id").alias("d"), F.lit(True).alias("known")),
                       (F.col("conv_id").eqNullSafe(F.col("c"))) & (F.col("dep") == F.col("d")), "left")
    edges = stored(edges.select("conv_id", "call_id", "dep", F.coalesce("known", F.lit(False)).alias("known")),
                   "call-edges")
    missing = edges.where("not known").groupBy("conv_id", "call_id").agg(F.count("*").alias("n_missing"))
    left, waits, levels, level = ids, edges.where("known").select("conv_id", "call_id", "dep"), None, 0
    while True:
        blocked = waits.select(F.col("conv_id").alias("rc"), F.col("call_id").alias("ri")).distinct()
        split = stored(left.join(blocked, [F.col("conv_id").eqNullSafe(F.col("rc")), F.col("call_id") == F.col("ri")],
                                 "left").select("conv_id", "call_id", F.col("ri").isNull().alias("ready")), "call-round")
        ready = split.where("ready").select("conv_id", "call_id")
        if not ready.limit(1).count():
            rest = split.select("conv_id", "call_id", F.lit(None).cast("int").alias("level"))
            levels = rest if levels is None else levels.unionByName(rest)
            break
        done = ready.withColumn("level", F.lit(level))
        levels = done if levels is None else levels.unionByName(done)
        left = split.where("not ready").select("conv_id", "call_id")
        gone = ready.select(F.col("conv_id").alias("rc"), F.col("call_id").alias("rd"))
        waits = stored(waits.join(gone, [F.col("conv_id").eqNullSafe(F.col("rc")), F.col("dep") == F.col("rd")],
                                  "left_anti"), "call-waits")
        level += 1
    return (levels.join(missing.select(F.col("conv_id").alias("mc"), F.col("call_id").alias("mi"), "n_missing"),
                        [F.col("conv_id").eqNullSafe(F.col("mc")), F.col("call_id") == F.col("mi")], "left")
            .select("conv_id", "call_id", "level", F.coalesce("n_missing", F.lit(0)).alias("n_missing")))


def formatted(messages: DataFrame, calls: DataFrame, results: DataFrame,
              schemas: dict[str, dict[str, Param]]) -> DataFrame:
    """One record per message, call and unlinked result, in order: conv_id, position, kind, call_id, level, status,
    errors, json.

    ``messages``: conv_id, turn, role, content. ``calls``: conv_id, turn,
    call_id, tool, arguments, depends_on. ``results``: conv_id, turn, call_id,
    content. A call takes the first result of its identifier (by turn, then
    content). Positions count from 0 in each conversation: plain messages, calls
    by level and turn, circular calls, loose results. Status of a call:
    ``duplicate`` (its identifier has an earlier call), ``no_id``, ``cycle``,
    ``invalid``, ``no_result`` or ``ok``; of a result without a call of its own:
    ``orphan``, or ``extra`` beyond the first. Null conversations are one.
    """
    calls = ranked_within(calls.select("conv_id", "turn", "call_id", "tool", "arguments", "depends_on"),
                          ["conv_id", "call_id"], ["turn", "tool", "arguments"], "nth", "calls")
    calls = stored(calls, "calls-ranked")
    results = stored(ranked_within(results.select("conv_id", "turn", "call_id", "content"), ["conv_id", "call_id"],
                                   ["turn", "content"], "nth", "results"), "results-ranked")
    first = calls.where("nth = 0 and call_id is not null")
    levels = topological_levels(first)
    linked = results.where("nth = 0 and call_id is not null").select(
        F.col("conv_id").alias("rc"), F.col("call_id").alias("ri"), F.col("content").alias("result"),
        F.col("turn").alias("result_turn"))
    levels = levels.select(F.col("conv_id").alias("lc"), F.col("call_id").alias("li"), "level", "n_missing")
    on = lambda c, i: [F.col("conv_id").eqNullSafe(F.col(c)), F.col("call_id") == F.col(i), F.col("nth") == 0]
    call = (calls.join(linked.hint("shuffle_hash"), on("rc", "ri"), "left").join(levels, on("lc", "li"), "left")
            .withColumn("errors", argument_errors("tool", "arguments", schemas))
            .withColumn("status", F.when(F.col("call_id").isNull(), "no_id").when(F.col("nth") > 0, "duplicate")
                        .when(F.col("level").isNull(), "cycle").when(F.size("errors") > 0, "invalid")
                        .when(F.col("ri").isNull(), "no_result").otherwise("ok")))
    args = F.try_parse_json("arguments")
    call = call.select(
        "conv_id", "turn", F.lit("call").alias("kind"), "call_id", F.col("level").cast("int").alias("level"), "status",
        "errors", F.to_json(F.struct(
            args.alias("arguments"), F.when(args.isNull(), F.col("arguments")).alias("arguments_text"),
            F.array_sort("depends_on").alias("depends_on"), F.col("call_id").alias("id"), F.col("n_missing").alias("missing"),
            F.col("tool").alias("name"), "result", "status", F.lit("call").alias("type"))).alias("json"))
    owners = first.select(F.col("conv_id").alias("oc"), F.col("call_id").alias("oi"))
    loose = (results.join(owners, [F.col("conv_id").eqNullSafe(F.col("oc")), F.col("call_id") == F.col("oi")], "left")
             .where("oi is null or nth > 0")
             .withColumn("status", F.when(F.col("oi").isNull(), "orphan").otherwise("extra")))
    none = F.array().cast("array<string>")
    loose = loose.select(
        "conv_id", "turn", F.lit("result").alias("kind"), "call_id", F.lit(_LOOSE).alias("level"), "status",
        none.alias("errors"), F.to_json(F.struct(F.col("content"), F.col("call_id").alias("id"), "status",
                                                 F.lit("result").alias("type"))).alias("json"))
    plain = messages.select(
        "conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"),
        F.lit(_FIRST).alias("level"), F.lit("message").alias("status"), none.alias("errors"),
        F.to_json(F.struct("content", "role", F.lit("message").alias("type"))).alias("json"))
    records = plain.unionByName(call.withColumn("level", F.coalesce("level", F.lit(_CIRCULAR)))).unionByName(loose)
    placed = ranked_within(records, ["conv_id"], ["level", "turn", "kind", "call_id", "json"], "position", "records")
    shown = F.when(F.col("level").between(0, _CIRCULAR - 1), F.col("level"))
    return placed.select("conv_id", "position", "kind", "call_id", shown.alias("level"), "status",
                         F.concat_ws(",", "errors").alias("errors"), "json")


# --- Calls that the conversations table implies ---

SCHEMAS = {
    "search": {"query": Param("string", required=True), "limit": Param("integer", required=True, least=1, most=50)},
    "translate": {"text": Param("string", required=True),
                  "to": Param("string", required=True, among=("de", "en", "es", "fr"))},
    "summarise": {"text": Param("string", required=True), "ratio": Param("number", required=True, least=0, most=1)},
}


def implied(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, calls, results) of conversations (conv_id, turn, role, text).

    Each user turn calls a tool on its text, by turns search, translate and
    summarise; call k of a conversation builds on call (k - 1) / 2. The
    assistant's turn after it is the result. Other roles are plain messages.
    """
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"),
                                "role", F.col("text").alias("content"))
    k = F.floor(F.col("turn") / 2)
    ident = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    words = F.size(F.split(F.coalesce("content", F.lit("")), " "))
    user = rows.where("role = 'user'").withColumn("k", k).withColumn("n", words)
    calls = user.select(
        "conv_id", "turn", ident(F.col("turn")).alias("call_id"),
        F.element_at(F.array(F.lit("search"), F.lit("translate"), F.lit("summarise")),
                     (F.pmod(F.coalesce("k", F.lit(0)), F.lit(3)) + 1).cast("int")).alias("tool"),
        F.when(F.pmod("k", F.lit(3)) == 0, F.to_json(F.struct(F.col("content").alias("query"), F.col("n").alias("limit"))))
        .when(F.pmod("k", F.lit(3)) == 1, F.to_json(F.struct(
            F.element_at(F.array(*map(F.lit, ("fr", "de", "es", "en", "it"))), (F.pmod("n", F.lit(5)) + 1).cast("int")).alias("to"),
            F.col("content").alias("text"))))
        .otherwise(F.to_json(F.struct(F.col("content").alias("text"), F.when(F.col("n") >= 10, F.lit(10) / F.col("n"))
                                      .alias("ratio")))).alias("arguments"),
        F.when(F.col("k") >= 1, F.array(ident(2 * F.floor((F.col("k") - 1) / 2) + F.pmod("turn", F.lit(2)))))
        .otherwise(F.array().cast("array<string>")).alias("depends_on"))
    results = rows.where("role = 'assistant'").select("conv_id", "turn", ident(F.col("turn") - 1).alias("call_id"), "content")
    return rows.where("role is null or role not in ('user', 'assistant')"), calls, results
