"""Personal data: fixed patterns, and what their contexts lead to, in DataFrame functions only.

Base spans (e-mail, IP, card, phone) come from fixed expressions. They are the seeds of a bootstrap: the words around a seed form
lexical patterns, such as "two words before" or "one word before and one after". Patterns and values (the identifiers' texts) form a
bipartite graph. Each round scores a pattern for a kind by the share of its distinct values that are known to be of that kind, accepts
patterns with enough known values and a high share, and accepts values of the right shape whose accepted patterns leave little doubt;
these count as known in the next round. Rounds go on until nothing is added; the
last one scores the patterns by all known values. Every mention of an accepted value in an accepted pattern, outside the base spans,
is added.

Texts are handled once per distinct text (md5), and only those with a digit, an @, (at) or [at] at all.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillflow.llm.common import documents, forget, written

KINDS = ("email", "ip", "card", "phone")
# The kinds' expressions; possessive and anchored forms that match what the plain ones match, in linear time.
_LOCAL = "[A-Za-z0-9._%+-]"
FORMS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # tokens that could be identifiers: with a digit, an @, (at) or [at], and groups of digits that follow
    "token": r"(?<![^\x20\x09-\x0D])(?:(?!\([aA][tT]\)|\[[aA][tT]\])[^\x20\x09-\x0D0-9@])*+(?:[0-9@]|\([aA][tT]\)|\[[aA][tT]\])[^\x20\x09-\x0D]*+(?:\x20[(]?[0-9][0-9().-]*+)*+",
}
# What an added value of a kind must look like.
SHAPES = {
    "email": r"(?i)^[^@]+(@|\(at\)|\[at\])[^@]+$",
    "ip": r"^[0-9A-Fa-f]{1,4}([.:][0-9A-Fa-f]{0,4}){3,7}(:[0-9]+|/[0-9]+)?$",
    "card": r"^[0-9]([\x20./_-]?[0-9]){11,18}$",
    "phone": r"^[+(]*[0-9]([\x20()./_-]*[0-9]){6,14}$",
}
LIKELY = r"[0-9@]|\([aA][tT]\)|\[[aA][tT]\]"    # what a text with any mention holds
CONTEXT = 64                       # characters looked at on either side of a mention for its neighbouring words
SUPPORT = 3                        # distinct known values that a pattern needs
PURE = 0.6                         # share of a pattern's distinct values known to be of the kind
SURE = 0.7                         # of an added value: 1 - product of (1 - share) over its accepted patterns


def _digits(c: str) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: str) -> Column:
    return F.expr(f"""aggregate(sequence(1, length({digits})), 0, (s, i) -> s + if(i % 2 = 1,
        int(substring({digits}, -i, 1)), 2 * int(substring({digits}, -i, 1)) - if(substring({digits}, -i, 1) > '4', 9, 0))) % 10 = 0""")


def _matches(kind: str) -> Column:
    """Per match: its number, the length of the gap before it, the match, and CONTEXT characters of the gaps beside it."""
    found, gaps = f"m_{kind}", f"g_{kind}"
    return F.expr(f"""if(size({found}) = 0, array(), transform(sequence(0, size({found}) - 1), i -> named_struct(
        'kind', '{kind}', 'i', i, 'gap', length({gaps}[i]), 'value', {found}[i], 'left', right({gaps}[i], {CONTEXT}), 'right', left({gaps}[i + 1], {CONTEXT}))))""")


def mentions(texts: DataFrame) -> DataFrame:
    """(key, text) with distinct keys -> (key, kind, start, end, value, left, right), code points, end exclusive; base kinds checked."""
    likely = texts.filter(F.col("text").rlike(LIKELY))
    for kind, form in FORMS.items():
        likely = likely.withColumn(f"m_{kind}", F.regexp_extract_all("text", F.lit(form), F.lit(0))).withColumn(
            f"g_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("text", form, -1)).otherwise(F.array().cast("array<string>")))
    every = F.concat(*[_matches(k) for k in FORMS])
    rows = likely.select("key", F.explode(every).alias("x")).select("key", "x.*")
    before = Window.partitionBy("key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("value")
    rows = rows.withColumn("start", F.coalesce(F.sum(F.col("gap") + size).over(before), F.lit(0)) + F.col("gap")).withColumn("end", F.col("start") + size)
    rows = rows.withColumn("d", _digits("value")).withColumn("n", F.length("d"))
    part = "if(ltrim('0', p) = '', 0, try_cast(ltrim('0', p) AS bigint))"
    good = (F.when(F.col("kind") == "ip", F.expr(f"coalesce(forall(split(value, '[.]'), p -> coalesce({part}, 256) <= 255), false)"))
            .when(F.col("kind") == "card", F.when(F.col("n").between(16, 19), _luhn("d")).otherwise(False))
            .when(F.col("kind") == "phone", F.col("n").between(8, 15)).otherwise(True))
    return rows.filter(good).select("key", "kind", "start", "end", "value", "left", "right")


def free_tokens(found: DataFrame) -> DataFrame:
    """The token mentions, without punctuation at their ends, that overlap no base span."""
    edge = r"[^\p{L}\p{N}@+(\[]"
    lead = F.length(F.regexp_extract("value", f"^{edge}*", 0))
    tail = F.length(F.regexp_extract("value", r"[^\p{L}\p{N}]*$", 0))
    is_token = F.col("kind") == "token"
    rows = (found.withColumn("_lead", F.when(is_token, lead).otherwise(0)).withColumn("_tail", F.when(is_token, tail).otherwise(0))
            .filter("_lead + _tail < end - start")
            .withColumn("value", F.expr("substring(value, int(_lead) + 1, int(end - start - _lead - _tail))"))
            .withColumn("start", F.col("start") + F.col("_lead")).withColumn("end", F.col("end") - F.col("_tail")).drop("_lead", "_tail"))
    order = Window.partitionBy("key").orderBy("start", "end")
    reach = F.max(F.when(~is_token, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    following = F.min(F.when(~is_token, F.col("start"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return (rows.withColumn("_reach", reach).withColumn("_following", following).filter(is_token)
            .filter("coalesce(_reach, 0) <= start and coalesce(_following, end) >= end").drop("_reach", "_following"))


def patterns(rows: DataFrame) -> DataFrame:
    """A row per mention and pattern it stands in: two words before; one before and one after; one word before with a colon or equals sign."""
    spoken = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    rows = rows.withColumn("_l", spoken(F.col("left"))).withColumn("_r", spoken(F.col("right")))
    last = lambda n: F.get("_l", F.size("_l") - n)
    return rows.withColumn("pattern", F.explode(F.array_compact(F.array(
        F.concat(F.lit("2 "), last(2), F.lit(" "), last(1)),
        F.concat(F.lit("1+1 "), last(1), F.lit(" _ "), F.get("_r", F.lit(0))),
        F.when(F.col("left").rlike(r"[\p{L}\p{N}][:=][\x20\x09]*$"), F.concat(F.lit("cue "), last(1))))))).drop("_l", "_r", "left", "right")


def bootstrap(found: DataFrame) -> DataFrame:
    """(key, kind, start, end) of added spans, from the mentions of all texts. No seeds, or contexts that never agree: none."""
    base = found.filter("kind <> 'token'")
    tokens = free_tokens(found)
    placed = written(patterns(base.unionByName(tokens)), "contexts")
    graph = placed.select("pattern", "value").distinct()
    totals = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))
    graph = written(graph.join(totals, "pattern"), "graph")
    known = written(base.select("value", "kind").distinct(), "known")
    shaped = reduce(lambda a, b: a | b, [(F.col("kind") == k) & F.col("value").rlike(s) for k, s in SHAPES.items()])
    accepted, grown = None, True
    while grown:                                         # known values only grow, up to the values there are
        if accepted is not None:
            forget(accepted)
        scored = (graph.join(known, "value").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("hits"), F.max("total").alias("total"))
                  .withColumn("share", F.col("hits") / F.col("total")).filter((F.col("hits") >= SUPPORT) & (F.col("share") >= PURE)))
        accepted = written(scored.select("pattern", "kind", "share"), "patterns")
        doubt = F.sum(F.log1p(-F.least("share", F.lit(0.999))))
        new = (graph.join(accepted, "pattern").groupBy("value", "kind").agg(doubt.alias("doubt"))
               .filter((1 - F.exp("doubt")) >= SURE).filter(shaped).select("value", "kind").join(known, ["value", "kind"], "left_anti"))
        following = written(known.unionByName(new), "known")
        grown = following.count() > known.count()
        forget(known)
        known = following
    hits = placed.filter("kind = 'token'").drop("kind").join(accepted, "pattern").join(known, ["value", "kind"])
    one = hits.groupBy("key", "start", "end").agg(F.max(F.struct("share", "kind")).alias("b"))
    return one.select("key", "b.kind", "start", "end")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, of an array of (place of the kind, start, end)."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.get(name, x["k"]), x["start"], x["end"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): counts of base spans by kind, digest of the base spans, and all spans.

    A null text counts as empty and has no spans; repeated rows are kept; other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.md5(F.col("text").cast("binary")))
    some = docs.filter(F.col("text").rlike(LIKELY)).select("key", "text").dropDuplicates(["key"])
    found = written(mentions(some), "mentions")
    added = bootstrap(found)
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    rows = (found.filter("kind <> 'token'").select("key", place.alias("k"), "start", "end", F.lit(True).alias("base"))
            .unionByName(added.select("key", place.alias("k"), "start", "end", F.lit(False).alias("base"))))
    span = F.struct("k", "start", "end")
    of = rows.groupBy("key").agg(F.collect_list(F.when(F.col("base"), span)).alias("base"), F.collect_list(span).alias("spans"))
    count = lambda k: F.coalesce(F.size(F.filter("base", lambda x: x["k"] == k)), F.lit(0)).cast("long").alias(f"n_{KINDS[k]}")
    text = F.coalesce(joined(F.col("base")), F.lit(""))
    return docs.select("doc_id", "key").join(of, "key", "left").select(
        "doc_id", *[F.when(F.col("base").isNull(), F.lit(0).cast("long")).otherwise(count(k)).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(text, 256).alias("base_sha256"), F.coalesce(joined(F.col("spans")), F.lit("")).alias("spans"))


def op9_personal_data(spark, sf_dir):
    return personal_data(documents(spark, sf_dir))
