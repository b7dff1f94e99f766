"""Balances: observations, carry-forward and drift (DOM22-DOM24, DOM42)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def daily_balances(observed: DataFrame, flows: DataFrame) -> DataFrame:
    """DOM23: (account_id, date, balance, currency_code, precedence) and (account_id, date, amount,
    currency_code) to one row per account and day, from the account's first observation to the last
    date of all.  On a day with observations the one of highest precedence (then greatest balance)
    holds; between them the last one is carried, moved by flows in its own currency.  ``delta`` is
    what an observation differs by from what was carried to it; null at the first one and where the
    currency changes."""
    best = observed.groupBy("account_id", "date").agg(F.max(F.struct("precedence", "balance", "currency_code")).alias("o"))
    best = best.select("account_id", "date", F.col("o.balance").alias("balance"), F.col("o.currency_code").alias("currency_code"))
    by_day = W.partitionBy("account_id").orderBy("date")
    best = best.withColumn("seg", F.row_number().over(by_day))
    end = best.agg(F.max("date").alias("end"))
    spine = best.groupBy("account_id").agg(F.min("date").alias("start")).crossJoin(F.broadcast(end))
    spine = spine.select("account_id", F.explode(F.expr("sequence(start, end, interval 1 day)")).alias("date"))
    x = spine.join(best.select("account_id", "date", F.col("balance").alias("seen"), F.col("currency_code").alias("seen_currency"), F.lit(1).alias("one")), ["account_id", "date"], "left")
    before = by_day.rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("seg", F.coalesce(F.sum("one").over(before), F.lit(0)))
    prev = best.select("account_id", F.col("seg").cast("long").alias("seg"), F.col("balance").alias("base"), F.col("currency_code").alias("base_currency"))
    x = x.join(prev, ["account_id", "seg"], "left")
    f = flows.groupBy("account_id", F.col("date").alias("fd"), F.col("currency_code").alias("fc")).agg(F.sum("amount").alias("flow")).withColumnRenamed("account_id", "fa")
    on = (F.col("account_id") == F.col("fa")) & (F.col("date") == F.col("fd")) & F.col("base_currency").eqNullSafe(F.col("fc")) & F.col("base").isNotNull()
    x = x.join(f, on, "left")
    run = W.partitionBy("account_id", "seg").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    carried = F.col("base") + F.sum(F.coalesce("flow", F.lit(0))).over(run)
    x = x.withColumn("carried", carried)
    same = F.col("base").isNotNull() & F.col("base_currency").eqNullSafe(F.col("seen_currency"))
    return x.select(
        "account_id", "date", F.coalesce("seen", "carried").cast("decimal(18,2)").alias("balance"),
        F.when(F.col("one") == 1, F.col("seen_currency")).otherwise(F.col("base_currency")).alias("currency_code"),
        (F.col("one") == 1).eqNullSafe(True).alias("observed"),
        F.when((F.col("one") == 1) & same, F.col("seen") - F.col("carried")).cast("decimal(18,2)").alias("delta"),
    )


def drift_status(delta, asserted_currency=None, computed_currency=None):
    """DOM24: clean below 1, warning below 10, drift beyond; no-data, currency-mismatch."""
    size = F.abs(delta)
    out = F.when(delta.isNull(), "no-data").when(size < 1, "clean").when(size < 10, "warning").otherwise("drift")
    return out if asserted_currency is None else F.when(~asserted_currency.eqNullSafe(computed_currency), "currency-mismatch").otherwise(out)


def running_balance_check(rows: DataFrame, least: float = 0.9, slack: float = 0.01) -> DataFrame:
    """DOM42: (file, row, amount, balance): share of steps that the amounts explain, or explain with
    the sign turned."""
    step = F.col("balance") - F.lag("balance").over(W.partitionBy("file").orderBy("row"))
    x = rows.withColumn("step", step).where("step is not null")
    x = x.groupBy("file").agg(F.avg((F.abs(F.col("step") - F.col("amount")) <= slack).cast("double")).alias("matched"), F.avg((F.abs(F.col("step") + F.col("amount")) <= slack).cast("double")).alias("inverted"))
    return x.withColumn("verdict", F.when(F.col("matched") >= least, "valid").when(F.col("inverted") >= least, "inverted").otherwise("invalid"))
