"""What the one pass over fills says about them."""

import pytest

from tidemark.operators import decisions

FIELDS = "transaction_hash string, market_id string, taker string, nonusdc_side string, taker_direction string, timestamp timestamp, price_observed double, price_outcome1 double, token_amount double, usd_amount double"


def fills(spark, *rows):
    data = [(tx, "m", taker, "token1", way, None, 0.5, 0.5, 1.0, 0.5, at) for tx, taker, way, at in rows]
    found = spark.createDataFrame(data, FIELDS + ", at long")
    return found.selectExpr("* except (timestamp, at)", "timestamp_seconds(at) as timestamp")


def test_each_error_and_none(spark):
    good = [("a", "u", "BUY", 1), ("a", "v", "SELL", 1), ("b", "u", "BUY", 2), ("b", "u", "BUY", None)]
    decisions.check_decisions(fills(spark, *good))
    for bad, said in (((" ", "u", "BUY", 1), "transaction_hash is missing in 1"), ((None, "u", "BUY", 1), "transaction_hash is missing in 1"), (("c", "", "BUY", 1), "taker is missing in 1"), (("c", "u", None, 1), "taker_direction is unknown in 1"), (("a", "w", "BUY", 3), "conflicting")):
        with pytest.raises(ValueError, match=said):
            decisions.check_decisions(fills(spark, *good, bad))
    with pytest.raises(ValueError, match="no participant fills"):
        decisions.check_decisions(fills(spark, *good).limit(0))
