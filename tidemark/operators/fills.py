"""Raw fills: validation, one price scale, log identity, participants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import event_time, number, require_columns

# Exchange deployments and the zero address.
EXCHANGES = (
    "0x4bfb41d5b3570defd03c39a9a4d8de6bd8b8982e",
    "0xc5d563a36ae78145c45a50134d48a1215220f80a",
    "0xe111180000d2663c0091e4f400237545b87b996b",
    "0xe2222d279d744050d28e00520010520000310f59",
    "0x0000000000000000000000000000000000000000",
)
CHECKED = ("market_id", "timestamp", "price_outcome1", "token_amount", "usd_amount")


def guard(df: DataFrame, kind: str) -> None:
    if kind not in ("quant", "trades"):
        raise ValueError("kind must be 'quant' or 'trades'")
    if {"user", "role"} & set(df.columns):
        raise ValueError("rows of users aren't rows of trades")
    require_columns(df, ["market_id", "timestamp", "price", "token_amount", "usd_amount", *(["nonusdc_side"] if kind == "trades" else [])])


def typed(df: DataFrame, kind: str) -> DataFrame:
    """Coerced columns and `valid`; nothing is dropped."""
    guard(df, kind)
    out = df.withColumns({"market_id": F.col("market_id").cast("string"), "timestamp": event_time(df, "timestamp"), **{c: number(c) for c in ("price", "token_amount", "usd_amount")}})
    valid = F.col("timestamp").isNotNull() & F.col("price").between(0, 1) & (F.col("token_amount") > 0) & (F.col("usd_amount") >= 0) & (F.col("market_id") != "nan")
    if kind == "trades":
        valid &= F.col("nonusdc_side").isin("token1", "token2")
    return out.withColumn("valid", F.coalesce(valid, F.lit(False)))


def outcome_price(kind: str) -> Column:
    return F.when(F.col("nonusdc_side") == "token2", 1 - F.col("price")).otherwise(F.col("price")) if kind == "trades" else F.col("price")


def valid_fills(df: DataFrame, kind: str = "trades") -> DataFrame:
    """Valid rows with price_observed and price_outcome1."""
    return typed(df, kind).where("valid").drop("valid").withColumns({"price_observed": F.col("price"), "price_outcome1": outcome_price(kind)})


def log_key(df: DataFrame) -> list[str]:
    """Columns that identify a log, or none if they are absent."""
    key = ["transaction_hash", "log_index"]
    return [] if set(key) - set(df.columns) else (["contract"] if "contract" in df.columns else []) + key


def log_conflicts(fills: DataFrame) -> DataFrame:
    """Log identities whose rows differ in a checked column, with the row count. Null keys identify nothing."""
    key = log_key(fills)
    named = fills.where(" and ".join(f"{k} is not null" for k in key))
    # Distinct values of one column, null included: a set of structs keeps nulls apart from absence.
    spread = [F.size(F.collect_set(F.struct(c))).alias(f"n_{c}") for c in CHECKED]
    return named.groupBy(*key).agg(F.count("*").alias("n_rows"), *spread).where(" or ".join(f"n_{c} > 1" for c in CHECKED)).select(*key, "n_rows")


def dedup_logs(fills: DataFrame, check: bool = True) -> DataFrame:
    """One row for each log identity; rows with equal checked columns are told apart by all remaining columns, smallest first.

    Skipped when a valid row lacks its identity. With check, conflicting rows are an error.
    """
    key = log_key(fills)
    if not key or not fills.where(" or ".join(f"{k} is null" for k in ("transaction_hash", "log_index"))).isEmpty():
        return fills
    if check and not log_conflicts(fills).isEmpty():
        raise ValueError("conflicting records share a log identity")
    return first_of_each(fills, key)


def first_of_each(fills: DataFrame, key: list[str]) -> DataFrame:
    order = [F.col(c) for c in ("timestamp", "market_id", "price_outcome1", "token_amount", "usd_amount")] + [F.col(c) for c in sorted(set(fills.columns) - set(key) - set(CHECKED)) if dict(fills.dtypes)[c] in ("string", "double", "bigint", "int")]
    return fills.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def log_summary(df: DataFrame, kind: str = "trades") -> DataFrame:
    """One row, in one pass with partial aggregation: input_rows, valid_rows, unnamed (valid rows without an identity), repeated (valid rows
    beyond the first of their identity) and conflicts (identities whose valid rows differ in a checked column)."""
    rows = typed(df, kind).withColumn("price_outcome1", outcome_price(kind))
    key = log_key(rows)
    if not key:
        return rows.agg(F.count("*").alias("input_rows"), F.count_if("valid").alias("valid_rows"), *[F.lit(0).cast("long").alias(c) for c in ("unnamed", "repeated", "conflicts")])
    ends = [end(F.when(F.col("valid"), F.col(c))).alias(f"{name}_{c}") for c in CHECKED for name, end in (("least", F.min), ("most", F.max))]
    logs = rows.groupBy(*key).agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"), *ends)
    named = " and ".join(f"{k} is not null" for k in key)
    differs = " or ".join(f"least_{c} != most_{c}" for c in CHECKED)
    total = {"input_rows": "n", "valid_rows": "n_valid", "unnamed": "if(transaction_hash is null or log_index is null, n_valid, 0)", "repeated": "greatest(n_valid - 1, 0)", "conflicts": f"if({named} and ({differs}), 1, 0)"}
    return logs.agg(*[F.coalesce(F.sum(F.expr(e)), F.lit(0)).alias(name) for name, e in total.items()])


def normalize(df: DataFrame, kind: str = "trades", check: bool = True) -> tuple[DataFrame, DataFrame]:
    """(fills, one-row audit: input_rows, invalid_rows_removed, duplicate_logs_removed, valid_rows). One pass over df decides and counts; fills are the second."""
    seen = log_summary(df, kind).first()
    fills, key = valid_fills(df, kind), log_key(df)
    if key and not seen.unnamed:
        if check and seen.conflicts:
            raise ValueError("conflicting records share a log identity")
        fills, repeated = first_of_each(fills, key), seen.repeated
    else:
        repeated = 0
    counts = (seen.input_rows, seen.input_rows - seen.valid_rows, repeated, seen.valid_rows - repeated)
    return fills, df.sparkSession.createDataFrame([counts], "input_rows long, invalid_rows_removed long, duplicate_logs_removed long, valid_rows long")


def participant_fills(df: DataFrame) -> DataFrame:
    """Drops rows whose maker or taker is an exchange: an observed contract value or a known address, whatever its case."""
    out = df
    for side in ("maker", "taker"):
        if side in df.columns:
            low = F.lower(F.col(side))
            out = out.where(~F.coalesce(low.isin(*EXCHANGES), F.lit(False)))
            if "contract" in df.columns:
                seen = df.where("contract is not null").select(F.lower("contract").alias("_exchange")).distinct()
                out = out.join(seen, F.lower(F.col(side)) == F.col("_exchange"), "left_anti")
    return out
