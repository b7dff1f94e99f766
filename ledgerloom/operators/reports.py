"""Reports and service reads over the ledger (RPT, SVC), and their registry.

A report is a function of its inputs and typed parameters that gives a DataFrame; nothing runs
until an action.  All amounts are kept apart by currency, null being a currency of its own.
``as_of`` stands wherever a report depends on the day it is read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


@dataclass(frozen=True)
class Report:
    name: str
    run: Callable[..., DataFrame]
    params: dict[str, type] = field(default_factory=dict)
    grain: tuple[str, ...] = ()


REGISTRY: dict[str, Report] = {}


def report(name: str, grain: tuple[str, ...] = (), **params: type) -> Callable:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        REGISTRY[name] = Report(name, f, params, grain)
        return f

    return add


def catalogue(spark: SparkSession) -> DataFrame:
    """All reports: name, what they say of themselves, parameters and grain."""
    rows = [(r.name, (r.run.__doc__ or "").split("\n")[0], sorted(f"{k}:{t.__name__}" for k, t in r.params.items()), list(r.grain)) for r in REGISTRY.values()]
    return spark.createDataFrame(rows, "name string, about string, params array<string>, grain array<string>")


def resolve(name: str) -> Report:
    """A report by its name, with or without the namespace, letters in either case; one of several is an error."""
    wanted = name.strip().lower()
    found = [r for k, r in REGISTRY.items() if wanted in (k, k.split(":")[1])]
    if len(found) != 1:
        raise KeyError(f"{name}: {'several reports' if found else 'no report'}; there are {', '.join(sorted(REGISTRY))}")
    return found[0]


def execute(name: str, *inputs: DataFrame, **params) -> DataFrame:
    """Check the parameters' names and types, then build the report."""
    r = resolve(name)
    for k, v in params.items():
        if k not in r.params or v is not None and not isinstance(v, r.params[k]):
            raise TypeError(f"{name}: {k}={v!r}")
    return r.run(*inputs, **params)


def explain(name: str, *inputs: DataFrame, **params) -> dict:
    """RPT10: columns, grain and the plan of a report."""
    df = execute(name, *inputs, **params)
    return {"name": name, "grain": resolve(name).grain, "columns": df.dtypes, "plan": df._jdf.queryExecution().toString()}


def user_report(spark: SparkSession, sql: str, max_rows: int | None = None, **params) -> DataFrame:
    """RPT09: a saved SELECT with named, typed parameters."""
    from ..plans.adhoc import query

    return query(spark, sql, max_rows, params)


def _money(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def budget_status(budgets: DataFrame, txns: DataFrame, warn: float = 0.8) -> DataFrame:
    """AGG20, SVC03: category, spent and OK, WARNING (over 80% of the budget) or OVER."""
    s = txns.where("amount < 0").groupBy("category").agg(F.sum(-F.col("amount")).alias("s"))
    spent = F.coalesce("s", F.lit(0))
    state = F.when(spent > F.col("budget"), "OVER").when(spent > F.col("budget") * F.lit(warn).cast("decimal(4,2)"), "WARNING").otherwise("OK")
    return budgets.join(s, "category", "left").select("category", _money(spent).alias("spent"), state.alias("state"))


@report("core:cashflow", ("month", "account_id", "category", "currency_code"), by=str, from_month=str, to_month=str)
def cashflow(txns: DataFrame, by: str = "account-and-category", from_month: str | None = None, to_month: str | None = None) -> DataFrame:
    """RPT01: inflow, outflow and net by month, ranked by size of net within month and currency."""
    keys = {"account": ["account_id"], "category": ["category"], "account-and-category": ["account_id", "category"]}[by]
    t = txns.withColumn("month", F.date_format("transaction_date", "yyyy-MM"))
    if from_month:
        t = t.where(F.col("month") >= from_month)
    if to_month:
        t = t.where(F.col("month") <= to_month)
    a = F.col("amount")
    x = t.groupBy("month", *keys, "currency_code").agg(F.sum(F.when(a > 0, a).otherwise(0)).alias("inflow"), F.sum(F.when(a < 0, a).otherwise(0)).alias("outflow"), F.sum(a).alias("net"), F.count("*").alias("txn_count"))
    w = W.partitionBy("month", "currency_code").orderBy(F.abs("net").desc(), *[F.col(k).asc_nulls_last() for k in keys])
    return x.select("month", *keys, "currency_code", *[_money(F.col(c)).alias(c) for c in ("inflow", "outflow", "net")], "txn_count", F.row_number().over(w).cast("long").alias("rank"))


@report("core:spending", ("month", "category", "currency_code"))
def spending_trend(txns: DataFrame) -> DataFrame:
    """RPT02: spending by month, category and currency, dense within each currency's own span, with the
    month before, the year before and the trailing three months' mean."""
    m = txns.where("amount < 0").groupBy(F.trunc("transaction_date", "month").alias("month"), "category", "currency_code").agg(F.sum(-F.col("amount")).alias("spend"), F.count("*").alias("n"))
    span = m.groupBy(F.col("currency_code").alias("cc")).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    cal = span.select("cc", F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("mm"))
    pairs = m.select(F.col("category").alias("pc"), F.col("currency_code").alias("pk")).distinct()
    dense = cal.join(pairs, F.col("cc").eqNullSafe(F.col("pk"))).select("mm", "pc", "pk")
    on = (F.col("mm") == F.col("month")) & F.col("pc").eqNullSafe(F.col("category")) & F.col("pk").eqNullSafe(F.col("currency_code"))
    x = dense.join(m, on, "left").select(F.col("mm").alias("month"), F.col("pc").alias("category"), F.col("pk").alias("currency_code"), _money(F.coalesce("spend", F.lit(0))).alias("total_spend"), F.coalesce("n", F.lit(0)).alias("txn_count"))
    w = W.partitionBy("category", "currency_code").orderBy("month")
    spend = F.col("total_spend")
    x = x.withColumn("prev_month_spend", F.lag("total_spend", 1).over(w)).withColumn("prev_year_spend", F.lag("total_spend", 12).over(w))
    change = lambda p: F.when(F.col(p) > 0, F.round((spend - F.col(p)).cast("double") / F.col(p).cast("double"), 6))
    return x.select(
        F.date_format("month", "yyyy-MM").alias("year_month"), "category", "currency_code", "total_spend", "txn_count", "prev_month_spend", _money(spend - F.col("prev_month_spend")).alias("mom_delta"), change("prev_month_spend").alias("mom_pct"),
        "prev_year_spend", _money(spend - F.col("prev_year_spend")).alias("yoy_delta"), change("prev_year_spend").alias("yoy_pct"), F.round(F.avg(spend.cast("double")).over(w.rowsBetween(-2, 0)), 6).alias("trailing_3mo_avg"),
    )


#: Cadence, mean interval from and to, and bound of its deviation, payments a year.
CADENCES = (("weekly", 5, 9, 2, 52), ("biweekly", 12, 16, 3, 26), ("monthly", 27, 33, 4, 12), ("quarterly", 85, 95, 7, 4), ("yearly", 355, 375, 14, 1))


@report("core:recurring", ("account_id", "merchant_id", "amount_bucket", "currency_code"), as_of=str)
def recurring(txns: DataFrame, as_of: str) -> DataFrame:
    """RPT03: charges of one size to one merchant, their cadence, confidence and yearly cost."""
    day = F.lit(as_of).cast("date")
    t = txns.where("amount < 0").where(F.col("transaction_date") >= F.add_months(day, -18)).withColumn("amount_bucket", F.round("amount", 0).cast("decimal(18,0)"))
    keys = ["account_id", "merchant_id", "amount_bucket", "currency_code"]
    w = W.partitionBy(*keys).orderBy("transaction_date")
    t = t.withColumn("gap", F.datediff("transaction_date", F.lag("transaction_date").over(w)).cast("double"))
    x = t.groupBy(*keys).agg(F.avg(F.abs("amount").cast("double")).alias("avg_amount"), F.avg("gap").alias("gap"), F.stddev_samp("gap").alias("sd"), F.count("*").alias("occurrences"), F.min("transaction_date").alias("first_seen"), F.max("transaction_date").alias("last_seen")).where("occurrences >= 3")
    gap, sd = F.col("gap"), F.col("sd")
    cadence, yearly = F.lit("irregular"), F.when(gap > 0, F.col("avg_amount") * (F.lit(365.25) / gap))
    for name, low, high, most, times in reversed(CADENCES):
        hit = F.coalesce(gap.between(low, high) & (sd < most), F.lit(False))
        cadence, yearly = F.when(hit, name).otherwise(cadence), F.when(hit, F.col("avg_amount") * times).otherwise(yearly)
    active = F.datediff(day, "last_seen") <= F.greatest(F.lit(60.0), gap * 2)
    sure = F.least(F.lit(1.0), F.col("occurrences") / 6.0) * F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.coalesce(sd, F.lit(14.0)) / 14.0))
    return x.select(*keys, F.round("avg_amount", 2).alias("avg_amount"), cadence.alias("cadence"), F.round(gap, 4).alias("interval_days_avg"), "occurrences", "first_seen", "last_seen", F.when(active, "active").otherwise("inactive").alias("status"), F.round(yearly, 2).alias("annualized_cost"), F.round(sure, 4).alias("confidence"))


@report("core:merchants", ("merchant_id", "currency_code"), top=int)
def merchants(txns: DataFrame, top: int | None = None) -> DataFrame:
    """RPT04: lifetime figures of each merchant in each currency, ranked within the currency."""
    a = F.col("amount")
    base = txns.groupBy("merchant_id", "currency_code").agg(
        F.sum(F.when(a < 0, -a).otherwise(0)).alias("total_spend"), F.sum(F.when(a > 0, a).otherwise(0)).alias("total_inflow"), F.count("*").alias("txn_count"), F.round(F.avg(a.cast("double")), 6).alias("avg_amount"),
        F.round(F.median(a.cast("double")), 6).alias("median_amount"), F.min("transaction_date").alias("first_seen"), F.max("transaction_date").alias("last_seen"), F.countDistinct(F.trunc("transaction_date", "month")).alias("active_months"), F.countDistinct("account_id").alias("account_count"),
    )
    modes = txns.where("category is not null").groupBy(F.col("merchant_id").alias("m"), F.col("currency_code").alias("c"), "category").agg(F.count("*").alias("n"))
    modes = modes.groupBy("m", "c").agg(F.min_by("category", F.struct(-F.col("n"), "category")).alias("top_category"))
    x = base.join(modes, F.col("merchant_id").eqNullSafe(F.col("m")) & F.col("currency_code").eqNullSafe(F.col("c")), "left").drop("m", "c")
    w = W.partitionBy("currency_code").orderBy(F.desc("total_spend"), F.col("merchant_id").asc_nulls_last())
    x = x.withColumn("rank", F.row_number().over(w).cast("long")).withColumns({c: _money(F.col(c)) for c in ("total_spend", "total_inflow")})
    return x if top is None else x.where(F.col("rank") <= top)


@report("core:large_transactions", ("transaction_id",), top=int)
def large_transactions(txns: DataFrame, top: int = 100) -> DataFrame:
    """RPT05: modified z-scores against the account's and the category's median, and the largest of each currency."""
    x = txns.withColumn("size", F.abs("amount").cast("double"))

    def score(keys: list[str], name: str, least: int):
        m = x.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.median("size").alias("med"), F.count("*").alias("n"))
        on = F.lit(True)
        for k in keys:
            on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
        d = x.join(m, on).groupBy(*[f"_{k}" for k in keys], "med", "n").agg(F.median(F.abs(F.col("size") - F.col("med"))).alias("mad"))
        z = F.when((F.col("mad") > 0) & (F.col("n") >= least), F.round((F.col("size") - F.col("med")) / (1.4826 * F.col("mad")), 4))
        return d, on, z.alias(name), keys

    # only the largest of each task's rows are shuffled: a rank that is filtered at once is limited before it
    rank = F.row_number().over(W.partitionBy("currency_code").orderBy(F.abs("amount").desc(), "transaction_id"))
    best = x.select("currency_code", "amount", "transaction_id").withColumn("rank", rank).where(F.col("rank") <= top)
    best = best.select(F.col("transaction_id").alias("_t")).distinct()
    out = x.join(best, F.col("transaction_id") == F.col("_t"), "left").withColumn("is_top", F.col("_t").isNotNull()).drop("_t")
    for keys, name, least in ((["account_id", "currency_code"], "amount_zscore_account", 1), (["category", "currency_code"], "amount_zscore_category", 5)):
        d, on, z, _ = score(keys, name, least)
        if "category" in keys:
            d = d.where("_category is not null")
        out = out.join(d, on, "left").withColumn(name, z).drop("med", "n", "mad", *[f"_{k}" for k in keys])
    return out.select("transaction_id", "amount_zscore_account", "amount_zscore_category", "is_top")


@report("core:balance_drift", ("account_id", "assertion_date"), as_of=str)
def balance_drift(asserted: DataFrame, computed: DataFrame, as_of: str) -> DataFrame:
    """RPT06: (account_id, assertion_date, balance, currency_code) against daily balances."""
    from .balances import drift_status

    c = computed.select(F.col("account_id").alias("ca"), F.col("date").alias("cd"), F.col("balance").alias("cb"), F.col("currency_code").alias("cc"))
    x = asserted.join(c, (F.col("account_id") == F.col("ca")) & (F.col("assertion_date") == F.col("cd")), "left")
    drift = F.col("balance") - F.col("cb")
    status = F.when(F.col("cb").isNull(), "no-data").otherwise(drift_status(drift, F.col("currency_code"), F.col("cc")))
    return x.select("account_id", "assertion_date", F.col("balance").alias("asserted"), F.col("cb").alias("computed"), _money(drift).alias("drift"), F.datediff(F.lit(as_of), "assertion_date").cast("long").alias("days"), status.alias("status"))


@report("core:networth", ("currency_code",), as_of=str)
def networth(daily: DataFrame, as_of: str | None = None) -> DataFrame:
    """RPT07: assets, liabilities and net of the last day on or before ``as_of``."""
    d = daily if as_of is None else daily.where(F.col("date") <= F.lit(as_of).cast("date"))
    last = d.agg(F.max("date").alias("last"))
    x = d.join(F.broadcast(last), F.col("date") == F.col("last"))
    b = F.col("balance")
    return x.groupBy("currency_code", F.col("date").alias("balance_date")).agg(_money(F.sum(F.when(b > 0, b).otherwise(0))).alias("assets"), _money(F.sum(F.when(b < 0, b).otherwise(0))).alias("liabilities"), _money(F.sum(b)).alias("net_worth"), F.countDistinct("account_id").alias("accounts"))


@report("core:networth_history", ("period", "currency_code"), interval=str)
def networth_history(daily: DataFrame, interval: str = "month") -> DataFrame:
    """RPT08: net worth at each period's last day, and the change from the period before."""
    day = daily.groupBy("date", "currency_code").agg(F.sum("balance").alias("net"))
    x = day.groupBy(F.trunc("date", interval).alias("period") if interval != "day" else F.col("date").alias("period"), "currency_code").agg(F.max_by("net", "date").alias("net"))
    w = W.partitionBy("currency_code").orderBy("period")
    return x.select("period", "currency_code", _money(F.col("net")).alias("net_worth"), _money(F.col("net") - F.lag("net").over(w)).alias("change"))


def spending_summary(txns: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """SVC01: income, expenses and net by month, all currencies together as this read always did."""
    t = txns
    if start:
        t = t.where(F.col("transaction_date") >= F.lit(start).cast("date"))
    if end:
        t = t.where(F.col("transaction_date") <= F.lit(end).cast("date"))
    a = F.col("amount")
    return t.groupBy(F.date_format("transaction_date", "yyyy-MM").alias("month")).agg(_money(F.sum(F.when(a > 0, a).otherwise(0))).alias("income"), _money(F.sum(F.when(a < 0, -a).otherwise(0))).alias("expenses"), _money(F.sum(a)).alias("net"), F.count("*").alias("n"))


def by_category(txns: DataFrame, top: int = 10) -> DataFrame:
    """SVC02: the largest categories with their share of all spending."""
    s = txns.where("amount < 0").groupBy("category").agg(F.sum(-F.col("amount")).alias("s"), F.count("*").alias("n"))
    s = s.withColumn("pct", F.round(F.col("s").cast("double") * 100 / F.sum("s").over(W.partitionBy()).cast("double"), 1))
    return s.orderBy(F.desc("s"), F.col("category").asc_nulls_last()).limit(top).select("category", _money(F.col("s")).alias("spent"), "n", "pct")
