"""Native column functions: times, ids, numbers, relevance."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import Market

#: An ISO date-time that ends with its offset.
_AWARE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})$"


_KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}


def schema_of(text: str) -> T.StructType:
    """A schema from `name kind` pairs; unlike StructType.fromDDL it needs no session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in text.split(","))])


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"Missing columns: {missing}")


def aware_time(value: Column) -> Column:
    """ISO text with an offset as a timestamp; anything else, also naive times, is null."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(_AWARE), text.try_cast("timestamp"))


def stamp(value: Column) -> Column:
    """As aware_time, but anything else is an error."""
    return F.coalesce(aware_time(value), F.raise_error(F.concat(F.lit("time needs an offset: "), F.coalesce(value.cast("string"), F.lit("null")))).cast("timestamp"))


def event_time(df: DataFrame, name: str) -> Column:
    """Epoch seconds (numbers or numeric text), aware ISO text or zoned timestamps; naive times are null."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.TimestampType):
        return c
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return F.lit(None).cast("timestamp")
    seconds = finite(c.try_cast("double"))
    return F.coalesce(F.when(F.abs(seconds) < 1e11, F.timestamp_micros(F.round(seconds * 1e6).cast("long"))), aware_time(c) if isinstance(kind, T.StringType) else F.lit(None).cast("timestamp"))


def finite(value: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(F.abs(value) < float("inf"), value)


def number(name: str) -> Column:
    return finite(F.col(name).try_cast("double"))


def micros(value: Column) -> Column:
    return F.unix_micros(value)


def iso(value: Column) -> Column:
    """ISO text in UTC with +00:00; microseconds only where there are some."""
    whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    rest = F.pmod(micros(value), F.lit(1_000_000))
    return F.concat(whole, F.when(rest != 0, F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0"))).otherwise(""), F.lit("+00:00"))


def short_hash(length: int, *parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def html_escape(value: Column) -> Column:
    """Text that may stand in HTML, also within quotes; null is "unknown"."""
    out = F.coalesce(value.cast("string"), F.lit("unknown"))
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def logit(p: Column, clip: float) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.ln(q / (1 - q))


def floor_micros(us: Column, width: int) -> Column:
    return us - F.pmod(us, F.lit(width))


def term_pattern(terms: Sequence[str]) -> str:
    """A regular expression for any of the terms between word boundaries, Unicode-aware."""
    return r"(?U)(?<!\w)(?:" + "|".join(re.sub(r"([^\w\s])", r"\\\1", t.lower()) for t in terms) + r")(?!\w)"


def relevance(text: Column, market: Market) -> Column:
    """Share of the market's term groups that the text hits; without groups 0."""
    if not market.required_term_groups:
        return F.lit(0.0)
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.when(low.rlike(term_pattern(g)), 1.0).otherwise(0.0) for g in market.required_term_groups]
    return sum(hits[1:], hits[0]) / len(hits)


def relevant_pairs(docs: DataFrame, text: Column, markets: Sequence[Market], name: str = "relevance", whole: bool = False) -> DataFrame:
    """docs once for each market, with market_id and its relevance; no join. whole: only for markets to which a document is fully relevant."""
    if not markets:
        return docs.withColumn("market_id", F.lit(None).cast("string")).withColumn(name, F.lit(0.0)).limit(0)
    each = F.array(*[F.struct(F.lit(m.market_id).alias("m"), relevance(text, m).alias("r")) for m in markets])
    if whole:
        each = F.filter(each, lambda p: p["r"] == 1.0)  # before rows are made, which carry the texts
    return docs.withColumn("_pair", F.explode(each)).withColumn("market_id", F.col("_pair.m")).withColumn(name, F.col("_pair.r")).drop("_pair")


def safe_json(text: Column) -> Column:
    """JSON that may stand inside HTML."""
    for raw, escaped in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text
