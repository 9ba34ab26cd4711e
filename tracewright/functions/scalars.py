"""Column builders for cleaning and reading source values."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions import fixed


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """Text value, null when it only says "no value" (as CSV readers do)."""
    c = _col(c)
    return F.when(~F.trim(c).isin(fixed.NA_TOKENS), c)


def quoted(column: str) -> str:
    return column if column.startswith("`") else f"`{column}`"


def clean(c: Column | str) -> Column:
    """Trimmed text; null, blanks and "nan" become ''."""
    return F.coalesce(F.nullif(F.trim(_col(c).cast("string")), F.lit("nan")), F.lit(""))


def filled(c: Column | str) -> Column:
    return ~clean(c).isin("", "None")


def present_sql(column: str) -> str:
    return f"nullif(nullif(trim(CAST({quoted(column)} AS STRING)), 'nan'), '')"


def present(c: Column | str) -> Column:
    """The trimmed value, or null when empty: ready for counting and joining."""
    return F.expr(present_sql(c)) if isinstance(c, str) else F.nullif(clean(c), F.lit(""))


# types whose text is neither blank nor padded
PLAIN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType, T.DateType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def object_key(columns: Iterable[str], types: dict[str, T.DataType] | None = None) -> Column:
    """Key parts joined by '|', null as soon as one part is empty. Values of plain ``types`` need no cleaning."""
    part = lambda c: f"CAST({quoted(c)} AS STRING)" if isinstance((types or {}).get(c), PLAIN) else present_sql(c)
    # concat (unlike concat_ws) is null when any part is null
    return F.expr("concat(" + ", '|', ".join(part(c) for c in columns) + ")")


def sort_text_sql(column: str, dtype: T.DataType) -> str:
    """Short text that differs for different values, holds no '|', and sorts like the value.

    A number carries the length of its whole part as a letter in front (a for
    one digit), so 7 is a7 and 12 is b12; negative ones are shifted above zero
    behind a '-'. Fractions outside 0.001 .. 10 million are written to two
    decimals, and then exactly. In text '~' and '|' are written '~t' and '~p',
    and null is '~n', so parts joined by '|' can be told apart.
    """
    c = quoted(column)
    # the rare spellings go through a lambda, which Spark does not write into the method that runs for each row:
    # the JVM leaves methods of more than 8,000 bytes uncompiled, and a row then takes 30 times as long
    seldom = lambda text: f"element_at(transform(array({c}), __v -> {text}), 1)"
    if isinstance(dtype, WHOLE):
        digits = f"CAST({c} AS STRING)"
        below = "concat('-', lpad(CAST(CAST(__v AS DECIMAL(20,0)) + 9223372036854775808BD AS STRING), 19, '0'))"
        text = f"if({c} < 0, {seldom(below)}, concat(char(96 + length({digits})), {digits}))"
    elif isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        exact, rough = "CAST(__v AS STRING)", "try_cast(__v AS DECIMAL(22,2))"
        letter = "char(96 + length(CAST(try_cast(__v AS DECIMAL(22,0)) AS STRING)))"
        zero = f"concat(char(95 + instr(concat({exact}, '.'), '.')), {exact})"
        below = f"concat('-', lpad(CAST({rough} + 100000000000000000000BD AS STRING), 24, '0'), '=', {exact})"
        odd = (f"CASE WHEN __v = 0 THEN {zero} WHEN {rough} IS NULL THEN concat('~', {exact})"
               f" WHEN __v < 0 THEN {below} ELSE concat({letter}, CAST({rough} AS STRING), '=', {exact}) END")
        # the number of digits before the point, without looking at the text
        head = "CASE " + " ".join(f"WHEN {c} < 1{'0' * i} THEN '{chr(96 + i)}'" for i in range(1, 7)) + " ELSE 'g' END"
        text = f"if({c} >= 0.001 AND {c} < 10000000, concat({head}, CAST({c} AS STRING)), {seldom(odd)})"
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        text = f"date_format(CAST({c} AS TIMESTAMP), 'yyyyMMddHHmmssSSSSSS')"
    elif isinstance(dtype, T.BinaryType):
        text = f"hex({c})"
    else:
        plain = f"to_json({c})" if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)) else f"CAST({c} AS STRING)"
        text = f"replace(replace({plain}, '~', '~t'), '|', '~p')"
    return f"coalesce({text}, '~n')"


def seconds_of_day(c: Column | str) -> Column:
    """hh:mm[:ss[.f]], hhmmss or hmmss (lost leading zero) as seconds of the day."""
    text = clean(c)
    parts = F.split(F.substring_index(text, ".", 1), ":")
    from_text = (F.get(parts, F.lit(0)).cast("int") * 3600 + F.get(parts, F.lit(1)).cast("int") * 60
                 + F.coalesce(F.get(parts, F.lit(2)).cast("int"), F.lit(0)))
    digits = F.regexp_replace(text, r"\.0$", "")
    six = F.lpad(digits, 6, "0")
    h, m, s = (F.substring(six, i, 2).cast("int") for i in (1, 3, 5))
    return (F.when(text.rlike(fixed.TIME_TEXT), from_text)
            .when(digits.rlike(fixed.TIME_DIGITS), F.when((h < 24) & (m < 60) & (s < 60), h * 3600 + m * 60 + s)))


def first_timestamp(text: Column, patterns: dict[str, str]) -> Column:
    """First pattern that reads the text; ``patterns`` maps a shape regex to a format.

    The shape is tested first, so that only one format is ever tried per value.
    """
    return F.coalesce(*[F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(pattern)))
                        for shape, pattern in patterns.items()])


# the four spellings accepted for an event time
EVENT_TIME = {
    r"^\d{1,4}-\d{1,2}-\d{1,2}$": "y-M-d",
    r"^\d{1,4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$": "y-M-d'T'H:m:s",
    r"^\d{1,4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$": "y-M-d H:m:s",
    r"^\d{8}$": "yyyyMMdd",
}


def event_time(c: Column | str, dtype: T.DataType | None = None, time: Column | str | None = None) -> Column:
    """Instant of an event to the second; a separate time counts only when the date is at midnight."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        ts = F.date_trunc("second", _col(c).cast("timestamp"))
    else:
        ts = first_timestamp(clean(c), EVENT_TIME)
    if time is None:
        return ts
    secs = seconds_of_day(time)
    midnight = F.date_trunc("day", ts) == ts
    return F.when(midnight & secs.isNotNull(), F.timestamp_seconds(F.unix_timestamp(ts) + secs)).otherwise(ts)


def number(c: Column | str) -> Column:
    """Number in local spellings: 48.098,24 / 1,234.50 / 1.234.567 / 1 234 / 1'234.

    With both separators the last one is the decimal one; a single comma is a
    decimal comma; a repeated separator groups thousands.
    """
    text = F.regexp_replace(F.trim(_col(c).cast("string")), r"[ \u00a0']", "")

    def one_point(s: Column) -> Column:
        """The same number with a point as its only separator."""
        tail = lambda mark: F.length(F.substring_index(s, mark, -1))
        drop = lambda mark: F.replace(s, F.lit(mark), F.lit(""))
        return (F.when(s.contains(",") & s.contains("."),
                       F.when(tail(",") < tail("."), F.replace(drop("."), F.lit(","), F.lit("."))).otherwise(drop(",")))
                .when(s.like("%,%,%"), drop(",")).when(s.contains(","), F.replace(s, F.lit(","), F.lit(".")))
                .when(s.like("%.%.%"), drop(".")).otherwise(s))

    # transform over one value binds it to a name, so that it is worked out once
    plain = F.get(F.transform(F.array(text), one_point), F.lit(0))
    read = lambda p: F.when(p.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), p).try_cast("double")
    value = F.get(F.transform(F.array(plain), read), F.lit(0))
    return F.nullif(F.nullif(value, F.lit(float("inf"))), F.lit(float("-inf")))


# spellings of a date inside an attribute
DATE_HEAD = {
    r"^\d{8}$": "yyyyMMdd",
    r"^\d{1,2}\.\d{1,2}\.\d{4}$": "d.M.yyyy",
    r"^\d{1,2}/\d{1,2}/\d{4}$": "d/M/yyyy",
}
DATE_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def date_value(c: Column | str) -> Column:
    """Date inside an attribute value, as a timestamp (UTC)."""
    s = F.trim(_col(c).cast("string"))
    return F.coalesce(first_timestamp(F.substring(s, 1, 10), DATE_HEAD), F.when(s.rlike(DATE_ISO), s.try_cast("timestamp")))


def is_date_text(c: Column | str) -> Column:
    """A date, and not a plain number that merely reads like one."""
    s = F.trim(_col(c).cast("string"))
    plain = s.rlike(r"^-?\d+([.,]\d+)?$")
    return date_value(s).isNotNull() & (~plain | ((F.length(s) == 8) & F.substring(s, 1, 2).isin("19", "20")))


def month(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM")


def epoch(ts: Column | str) -> Column:
    return F.unix_timestamp(_col(ts))


def free_date(c: Column | str) -> Column:
    """Date in any of the common spellings, for profiling."""
    s = clean(c)
    return F.coalesce(first_timestamp(s, {
        r"^\d{8}$": "yyyyMMdd",
        r"^\d{4}-\d{1,2}-\d{1,2}$": "y-M-d",
        r"^\d{4}/\d{1,2}/\d{1,2}$": "y/M/d",
        r"^\d{1,2}\.\d{1,2}\.\d{4}$": "d.M.y",
        r"^\d{1,2}/\d{1,2}/\d{4}$": "M/d/y",
    }), F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), s.try_cast("timestamp")))


def glob_regex(pattern: str) -> str:
    """Shell-style pattern (* ? [..]) as an anchored regular expression on upper-case text."""
    out = ""
    i, p = 0, pattern.strip().upper()
    while i < len(p):
        ch = p[i]
        end = p.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif end > 0:
            body = p[i + 1:end]
            out += "[" + ("^" + body[1:] if body.startswith("!") else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(ch)
        i += 1
    return f"(?s)^{out}$"


def matches_any(c: Column | str, globs: Iterable[str]) -> Column:
    text = F.upper(F.trim(_col(c)))
    out = F.lit(False)
    for g in globs:
        if str(g).strip():
            out = out | text.rlike(glob_regex(str(g)))
    return out


def change_value(old: str, new: str, field: str | None = None) -> Column:
    """SET / REMOVE / CHANGE plus the field name, from an old and a new value."""
    o, n = clean(old), clean(new)
    kind = (F.when((o == "") & (n != ""), "SET").when((o != "") & (n == ""), "REMOVE")
            .when((o != "") & (n != ""), "CHANGE").otherwise(""))
    if field is None:
        return kind
    return F.when(kind == "", "").otherwise(F.trim(F.concat_ws(" ", kind, clean(field))))


def slice_value(column: str, start: int, length: int) -> Column:
    return F.substring(clean(column), start + 1, length)


def lookup(values: dict[str, str], c: Column) -> Column:
    """Value of a fixed translation, null when it is not listed."""
    if not values:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.element_at(F.create_map(*pairs), c)


def attribute_map(columns: Iterable[str], types: dict[str, T.DataType] | None = None) -> Column:
    """MAP of the non-empty columns by name."""
    columns = list(columns)
    if not columns:
        return F.expr("CAST(map() AS MAP<STRING,STRING>)")

    def value(c: str) -> str:
        text = f"CAST({quoted(c)} AS STRING)"
        return text if isinstance((types or {}).get(c), PLAIN) else f"CASE WHEN {present_sql(c)} IS NOT NULL THEN {text} END"

    pairs = ", ".join(f"'{c}', {value(c)}" for c in columns)
    return F.expr(f"map_filter(map({pairs}), (k, v) -> v IS NOT NULL)")
