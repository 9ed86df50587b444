"""Chat formatting: tool calls linked to their results, put in order, checked against schemas, and written as canonical JSON.

Calls and results meet in a hash join on conversation and identifier. A call follows the calls it depends on: where the turns
already say so, their order stands; where a dependency stands in the same or a later turn, the call moves behind it, and what depends
on it follows in rounds until nothing moves. Output is one row per message, call and result, so a conversation of any length is
spread over rows and never gathered.
"""
from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillflow.llm.common import forget, written

TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def canonical(value) -> str:
    """Keys in order, no blanks, characters as they are; a whole float is written as an integer."""
    def plain(v):
        if isinstance(v, float) and v.is_integer() and abs(v) < 2**53:
            return int(v)
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v
    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What in a value breaks a schema: type (one or a list; an unknown one fits nothing), enum, minimum, maximum, minLength, maxLength, items, properties, required, additionalProperties."""
    kind = schema.get("type")
    kinds = [kind] if isinstance(kind, str) else list(kind or [])
    if "integer" in kinds and isinstance(value, float) and value.is_integer():
        value = int(value)
    fits = lambda k: k in TYPES and isinstance(value, TYPES[k]) and not (isinstance(value, bool) and k in ("integer", "number"))
    if kinds and not any(map(fits, kinds)):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the values")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{at}: out of range")
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        out.append(f"{at}: length")
    if isinstance(value, list) and "items" in schema:
        out += [e for i, x in enumerate(value) for e in violations(x, schema["items"], f"{at}[{i}]")]
    if isinstance(value, dict):
        fields = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in fields:
                out += violations(value[k], fields[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: not known")
    return out


def _no_number(name: str):
    raise ValueError(f"{name} is no JSON")


def checked_arguments(text, schema: dict | None) -> tuple[str | None, str]:
    """(canonical arguments or null, what is wrong). Arguments that cannot be written again are null, with the reason."""
    if schema is None:
        return None, "unknown tool"
    try:
        value = json.loads(text, parse_constant=_no_number)
        wrong, written_again = violations(value, schema), canonical(value)
        written_again.encode("utf-8")
    except RecursionError:
        return None, "arguments are nested too deeply"
    except UnicodeEncodeError:
        return None, "arguments hold half a character"
    except (TypeError, ValueError):
        return None, "arguments are not JSON"
    return written_again, "; ".join(wrong)


def ordered_calls(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, turn, depends array) -> with at_turn, level: sorting by both puts every call behind its dependencies.

    at_turn, level is (turn, 0) unless a dependency stands in the same or a later turn; then it is one level behind that. Calls of a
    cycle, and those that wait for them, have `cyclic` true and stay at their own turn. Unknown or null dependencies are ignored.
    """
    edges = written(calls.select("conv_id", "call_id", F.explode("depends").alias("on")).filter("`on` is not null").distinct(), "depends")
    place = written(calls.select("conv_id", "call_id", "turn", F.col("turn").alias("at_turn"), F.lit(0).alias("level"), F.lit(False).alias("cyclic")), "places")
    sizes = calls.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_calls"))
    while True:
        on = place.select("conv_id", F.col("call_id").alias("on"), F.struct("at_turn", F.col("level").alias("level")).alias("p"))
        least = (edges.join(on, ["conv_id", "on"]).groupBy("conv_id", "call_id").agg(F.max("p").alias("p"))
                 .select("conv_id", "call_id", F.struct(F.col("p.at_turn").alias("at_turn"), (F.col("p.level") + 1).alias("level")).alias("after")))
        moved = (place.join(least, ["conv_id", "call_id"]).filter(~F.col("cyclic") & (F.col("after.at_turn") >= F.col("at_turn")) &
                                                                 ((F.col("after.at_turn") > F.col("at_turn")) | (F.col("after.level") > F.col("level"))))
                 .join(sizes, "conv_id").select("conv_id", "call_id", "after", (F.col("after.level") >= F.col("n_calls")).alias("loop")))
        moved = written(moved, "moved")
        if moved.isEmpty():
            return place
        following = place.join(moved, ["conv_id", "call_id"], "left").select(
            "conv_id", "call_id", "turn", F.when(F.col("loop"), F.col("turn")).otherwise(F.coalesce("after.at_turn", "at_turn")).alias("at_turn"),
            F.when(F.col("loop"), F.lit(0)).otherwise(F.coalesce("after.level", "level")).alias("level"), (F.col("cyclic") | F.coalesce("loop", F.lit(False))).alias("cyclic"))
        following = written(following, "places")
        forget(place)
        place = following


def chat_rows(messages: DataFrame, calls: DataFrame, results: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """messages (conv_id, turn, role, text), calls (conv_id, turn, call_id, name, arguments JSON text, depends array<string>) and results
    (conv_id, turn, call_id, content) -> a row each: conv_id, position (0 .. in the conversation), kind (message, call, result), turn,
    call_id, linked (of calls and results), error (of calls), json (canonical).

    Of several calls with one identifier the first by turn is linked, the others have error "identifier used before"; a result is linked
    if its conversation has the call, in whatever turn. A linked result stands behind its call. Ties go by turn, kind, identifier and
    text. Nulls in any column are written as null; repeated rows are kept; empty tables give no rows.
    """
    nth = Window.partitionBy("conv_id", "call_id").orderBy("turn", "name", "arguments")
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "depends").withColumn("nth", F.row_number().over(nth))
    first = calls.filter("nth = 1 and call_id is not null")
    place = ordered_calls(first.select("conv_id", "call_id", "turn", "depends")).drop("turn")
    answered = results.select("conv_id", "call_id").filter("call_id is not null").distinct().withColumn("answered", F.lit(True))

    @F.pandas_udf("arguments string, error string")
    def check(name: pd.Series, arguments: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([checked_arguments(a, tools.get(n)) for n, a in zip(name, arguments)], columns=["arguments", "error"])

    keys = ["conv_id", "call_id"]
    called = (calls.join(place.withColumn("nth", F.lit(1)), [*keys, "nth"], "left").join(answered, keys, "left").withColumn("c", check("name", "arguments"))
              .withColumn("twice", F.col("nth") > 1))
    error = F.concat_ws("; ", F.when(F.col("twice"), F.lit("identifier used before")), F.when(F.col("call_id").isNull(), F.lit("no identifier")),
                        F.when(F.col("cyclic"), F.lit("cyclic dependencies")), F.when(F.col("c.error") != "", F.col("c.error")))
    sent = called.select("conv_id", "turn", F.coalesce("at_turn", "turn").alias("at_turn"), F.coalesce("level", F.lit(0)).alias("level"), F.lit("call").alias("kind"),
                         "call_id", (F.coalesce("answered", F.lit(False)) & ~F.col("twice")).alias("linked"), error.alias("error"), F.lit("assistant").alias("role"),
                         F.lit(None).cast("string").alias("text"), "name", F.coalesce("c.arguments", "arguments").alias("arguments"), F.col("c.arguments").isNotNull().alias("parsed"))
    back = (results.select("conv_id", "turn", "call_id", "content").join(place.drop("cyclic"), keys, "left")
            .select("conv_id", "turn", F.greatest("turn", "at_turn").alias("at_turn"),
                    F.when(F.col("at_turn") >= F.col("turn"), F.col("level")).otherwise(0).alias("level"), F.lit("result").alias("kind"), "call_id",
                    F.col("at_turn").isNotNull().alias("linked"), F.lit(None).cast("string").alias("error"), F.lit("tool").alias("role"), F.col("content").alias("text"),
                    F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), F.lit(False).alias("parsed")))
    said = messages.select("conv_id", "turn", F.col("turn").alias("at_turn"), F.lit(-1).alias("level"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"),
                           F.lit(None).cast("boolean").alias("linked"), F.lit(None).cast("string").alias("error"), "role", "text", F.lit(None).cast("string").alias("name"),
                           F.lit(None).cast("string").alias("arguments"), F.lit(False).alias("parsed"))
    rank = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "call", 1).otherwise(2)
    order = Window.partitionBy("conv_id").orderBy("at_turn", "level", rank, "turn", "call_id", "text")

    @F.pandas_udf("string")
    def line(kind: pd.Series, role: pd.Series, text: pd.Series, call_id: pd.Series, name: pd.Series, arguments: pd.Series, parsed: pd.Series) -> pd.Series:
        def one(k, r, t, i, n, a, p):
            if k == "call":
                return canonical({"role": r, "tool_call": {"id": i, "name": n, "arguments": json.loads(a) if p else a}})
            return canonical({"role": r, "content": t} | ({"tool_call_id": i} if k == "result" else {}))
        return pd.Series([one(*x) for x in zip(kind, role, text, call_id, name, arguments, parsed)], dtype=object)

    rows = said.unionByName(sent).unionByName(back).withColumn("position", F.row_number().over(order) - 1)
    return rows.select("conv_id", "position", "kind", "turn", "call_id", "linked", "error", line("kind", "role", "text", "call_id", "name", "arguments", "parsed").alias("json"))


# ---- the conversations of the test tables hold no tools: a user's turn is read as a call, the assistant's next turn as its result ----
ASK = {"answer": {"type": "object", "required": ["question", "words"], "additionalProperties": False,
                  "properties": {"question": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 3, "maximum": 200}}}}


def conversations(spark, sf_dir: str) -> DataFrame:
    return spark.read.schema("conv_id long, turn long, role string, text string").parquet(f"{sf_dir}/conversations.parquet")


def turns_as_calls(chat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from the turns of a conversation.

    Half of the calls depend on the user's next call, so they must move behind it; the others on the one four turns before.
    """
    ident = lambda t: F.concat_ws(":", F.lit("call"), F.col("conv_id"), t)
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    calls = chat.filter("role = 'user'").select("conv_id", "turn", ident(F.col("turn")).alias("call_id"), F.lit("answer").alias("name"),
                                                F.to_json(F.struct(words.alias("words"), F.col("text").alias("question"))).alias("arguments"),
                                                F.array(ident(F.when(F.pmod("turn", F.lit(4)) < 2, F.col("turn") + 2).otherwise(F.col("turn") - 4))).alias("depends"))
    results = chat.filter("role = 'assistant'").select("conv_id", "turn", ident(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op10_chat(spark, sf_dir):
    chat = conversations(spark, sf_dir)
    calls, results = turns_as_calls(chat)
    return chat_rows(chat.filter("role is null or role not in ('user', 'assistant')"), calls, results, ASK)
