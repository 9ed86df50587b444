"""Column expressions shared by the operators. Everything here stays inside the JVM."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillflow.settings import AGE_BANDS, CLASSES, INVALID_CODE, MERCHANT_CODE_RANGES, SPAN_BANDS

N_CLASSES = len(CLASSES)


# ---- labels ------------------------------------------------------------------------------------------------
def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "\\'") + "'"


CLASS_LIST = "array(" + ", ".join(map(_sql_text, CLASSES)) + ")"        # SQL text: one call instead of one per literal


def category_of(mcc: str = "mcc", ranges: dict | None = None) -> Column:
    """Class name of a merchant code column; a code outside every listed range is the last class."""
    cases = [f"WHEN {' OR '.join(f'{mcc} BETWEEN {lo} AND {hi}' for lo, hi in spans)} THEN {_sql_text(name)}"
             for name, spans in (ranges or MERCHANT_CODE_RANGES).items()]
    return F.expr(f"CASE {' '.join(cases)} ELSE {_sql_text(CLASSES[-1])} END")


def code_of(mcc: str = "mcc") -> Column:
    """Class code of a merchant code column under the default ranges, without the detour over the name."""
    cases = [f"WHEN {' OR '.join(f'{mcc} BETWEEN {lo} AND {hi}' for lo, hi in spans)} THEN {CLASSES.index(name)}"
             for name, spans in MERCHANT_CODE_RANGES.items()]
    return F.expr(f"CASE {' '.join(cases)} ELSE {len(CLASSES) - 1} END")


def complete(df: DataFrame, columns) -> Column:
    """No listed column is null (or NaN). Written as single tests, which reach the file scan as pushed filters."""
    kinds = dict(df.dtypes)
    tests = [f"`{c}` IS NOT NULL" + (f" AND NOT isnan(`{c}`)" if kinds[c] in ("double", "float") else "") for c in columns]
    return F.expr(" AND ".join(tests))


def class_code(name: Column) -> Column:
    """Code 0..3 of a class name, 4 for any other text (or none)."""
    return F.coalesce(F.nullif(F.array_position(F.expr(CLASS_LIST), name), F.lit(0)) - 1, F.lit(INVALID_CODE)).cast("int")


def class_name(code: Column) -> Column:
    return F.get(F.expr(CLASS_LIST), code.cast("int"))


# ---- text, numbers, dates ----------------------------------------------------------------------------------
def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def normal_text(c: Column) -> Column:
    return F.lower(F.trim(c))


NUMBER_TEXT = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"


def parse_number(c: Column, decimal: str = ".") -> Column:
    """A number written with `decimal` as its decimal mark; null when the text is no number."""
    text = F.replace(F.trim(c), F.lit(decimal), F.lit("."))
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


# strptime directive -> Spark datetime pattern (one letter also accepts two digits)
_PATTERN = {"%Y": "yyyy", "%y": "yy", "%m": "M", "%d": "d", "%b": "MMM", "%B": "MMMM", "%H": "H", "%I": "h",
            "%p": "a", "%M": "m", "%S": "s", "%f": "SSSSSS", "%j": "D"}


def spark_pattern(strptime_format: str) -> str:
    out, rest = "", strptime_format
    while rest:
        if rest[0] == "%":
            if rest[:2] not in _PATTERN:
                raise ValueError(f"unsupported date directive {rest[:2]!r} in {strptime_format!r}")
            out, rest = out + _PATTERN[rest[:2]], rest[2:]
        else:
            out, rest = out + (f"'{rest[0]}'" if rest[0].isalpha() else rest[0]), rest[1:]
    return out


def parse_when(c: Column, strptime_format: str, out: str) -> Column:
    """Parse a date or time and print it with the Spark pattern `out`; null when it does not parse."""
    return F.date_format(F.try_to_timestamp(F.trim(c), F.lit(spark_pattern(strptime_format))), out)


def money(amount: Column, currency: str) -> Column:
    return F.concat(F.lit(currency + " "), amount.cast("decimal(18,2)").cast("string"))


# ---- bands (right-closed) ----------------------------------------------------------------------------------
def _band(c: Column, uppers, names) -> Column:
    out = F.lit(names[-1])
    for upper, name in reversed(list(zip(uppers, names))):
        out = F.when(c <= upper, F.lit(name)).otherwise(out)
    return out


def age_band(age: Column) -> Column:
    return F.when((age > 0) & (age <= 200), _band(age, (29, 39, 49, 59), AGE_BANDS))


def span_band(days: Column) -> Column:
    return F.when(days > -1, _band(days, (7, 30, 90), SPAN_BANDS))


# ---- hashing -----------------------------------------------------------------------------------------------
def draw_hash(seed, *parts: Column) -> Column:
    """32 hex digits that order rows at random: md5 of seed:part:part."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hash_uniform(seed, *parts: Column) -> Column:
    """A reproducible uniform number in [0, 1) from 32 bits of the draw hash."""
    return F.conv(F.substring(draw_hash(seed, *parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


# ---- arrays of class codes and of class probabilities --------------------------------------------------------
def argmax_code(a: Column) -> Column:
    """Position of the largest element, the lowest one on ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / total)


def in_top2(p: Column, truth: Column) -> Column:
    """Is the true class among the two most probable ones (lower codes first on ties)?"""
    pt = F.get(p, truth)
    ahead = F.lit(0)
    for j in range(N_CLASSES):
        pj = F.get(p, F.lit(j))
        ahead = ahead + F.when((pj > pt) | ((pj == pt) & (F.lit(j) < truth)), 1).otherwise(0)
    return ahead < 2


def probability_bin(p: Column, bins: int = 15) -> Column:
    """Equal-width bin 0..bins-1: the number of inner edges k/bins at or below p."""
    guess = F.floor(p * bins)
    # floor() can be one off next to an edge: compare with the edges themselves
    up = F.when(p >= (guess + 1) / F.lit(float(bins)), guess + 1).otherwise(guess)
    exact = F.when(p < up / F.lit(float(bins)), up - 1).otherwise(up)
    return F.least(F.greatest(exact, F.lit(0)), F.lit(bins - 1)).cast("int")


def count_code(codes: Column, k: int) -> Column:
    return F.size(F.filter(codes, lambda c: c == k))


def last_seen(codes: Column, k: int) -> Column:
    """Position (0 = oldest) of the most recent occurrence of class k, -1 if it never occurs."""
    from_end = F.array_position(F.reverse(codes), F.lit(k))
    return F.when(from_end > 0, F.size(codes) - from_end).otherwise(F.lit(-1)).cast("int")


def distinct_codes(codes: Column) -> Column:
    return F.size(F.array_distinct(codes))


def changes(codes: Column) -> Column:
    """Number of neighbours that differ."""
    n = F.size(codes)
    pairs = F.zip_with(F.slice(codes, F.lit(1), n - 1), F.slice(codes, F.lit(2), n - 1), lambda a, b: a != b)
    return F.when(n > 1, F.size(F.filter(pairs, lambda d: d))).otherwise(0)


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def array_median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    lo, hi = F.floor((n - 1) / 2).cast("int"), F.ceil((n - 1) / 2).cast("int")
    return (F.get(s, lo) + F.get(s, hi)) / 2
