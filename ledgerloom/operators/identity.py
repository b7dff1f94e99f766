"""Identity ladders and opening positions (PRJ02, DOM13, DOM16, DOM20, DOM25-DOM28, DOM43, DOM48, DOM50)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T

# Investment types by the provider's subtype (and type where it matters), in order.
BY_SUBTYPE = (
    (("dividend reinvestment", "interest reinvestment", "long-term capital gain reinvestment", "short-term capital gain reinvestment"), "reinvest"),
    (("assignment", "exercise", "expire"), "other"),
    (("buy to cover", "sell short"), "other"),
    (("stock distribution",), "transfer_in"),
    (("account fee", "legal fee", "management fee", "transfer fee", "trust fee", "fund fee", "miscellaneous fee", "margin expense", "tax", "tax withheld", "non-resident tax"), "fee"),
    (("dividend", "qualified dividend", "non-qualified dividend"), "dividend"),
    (("interest", "interest receivable"), "interest"),
    (("long-term capital gain", "short-term capital gain", "unqualified gain"), "capital_gain_distribution"),
    (("return of principal",), "return_of_capital"),
    (("split",), "split"),
    (("adjustment", "loan payment", "rebalance"), "other"),
)


def investment_type(ptype: Column, psub: Column, security: Column, amount: Column, quantity: Column) -> Column:
    """PRJ02, DOM25: the ledger's type, or null for what has to be reviewed."""
    moved = F.when(security.isNull(), F.when(amount > 0, "withdrawal").otherwise("deposit")).when(quantity > 0, "transfer_in").when(quantity < 0, "transfer_out").otherwise("other")
    out = F.when((ptype == "buy") & psub.isin("buy", "contribution"), "buy").when((ptype == "sell") & (psub == "sell"), "sell").when((ptype == "sell") & (psub == "distribution"), "transfer_out")
    out = out.when((ptype == "cash") & psub.isin("contribution", "deposit"), "deposit").when((ptype == "cash") & (psub == "withdrawal"), "withdrawal")
    for subs, kind in BY_SUBTYPE:
        out = out.when(psub.isin(*subs), kind)
    return out.when((ptype == "transfer") & psub.isin("transfer", "send", "merger", "spin off", "trade"), moved)


def resolve_accounts(incoming: DataFrame, known: DataFrame, pins: DataFrame, most: int = 25) -> DataFrame:
    """DOM13: (key, native_ref, token, slug, last_four, name, and number, a full number with its scope) to an
    account: a pin, then a strong reference (native, token, number), else a new id with proposals of the
    first signal that has any: ``institution_last4`` (all of the same institution and last four); ``name`` (the first
    account of that name whose last four do not contradict, and the first at the same institution whose do);
    ``institution_reissue`` (at most ``most`` accounts of the same institution, the least ids; both state last fours).
    Weak signals only propose.  Only names that are equal once normalised are alike.  A blank or null
    reference matches nothing; a key is expected once."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    key = lambda c: F.nullif(T.alias_key(F.col(c)), F.lit(""))
    strongs = [("native_ref", "native"), ("token", "token")] + ([("number", "number")] if "number" in incoming.columns and "number" in known.columns else [])
    x = incoming.select("key", *[blank(c).alias(c) for c, _ in strongs], key("slug").alias("slug"), blank("last_four").alias("four"), key("name").alias("name"))
    x = x.join(pins.groupBy("key").agg(F.min("account_id").alias("by_pin")), "key", "left")
    for c, n in strongs:
        unique = known.select(blank(c).alias(c), "account_id").where(F.col(c).isNotNull()).groupBy(c).agg(F.min("account_id").alias(f"by_{n}"), F.count("*").alias("n")).where("n = 1").drop("n")
        x = x.join(unique, c, "left")
    hows = ["pin", *[n for _, n in strongs]]
    strong = F.coalesce(*[F.col(f"by_{n}") for n in hows])
    k = known.select(F.col("account_id").alias("k_id"), key("slug").alias("slug"), blank("last_four").alias("k_four"), key("name").alias("name"))
    open_ = x.where(strong.isNull()).select("key", "slug", "four", "name")

    last4 = open_.join(k.select("k_id", "slug", F.col("k_four").alias("four")), ["slug", "four"]).select("key", F.lit("institution_last4").alias("signal"), "k_id")
    open_ = open_.join(last4.select("key"), "key", "left_anti")
    # of each name the first account of each last four is enough, so no group of equal names multiplies
    first = k.where("name is not null").groupBy("name", "k_four").agg(F.min("k_id").alias("k_id"))
    named = [
        open_.where("four is null").join(first.groupBy("name").agg(F.min("k_id").alias("k_id")), "name"),
        open_.join(first.withColumnRenamed("k_four", "four"), ["name", "four"]),
        open_.where("four is not null").join(first.where("k_four is null").drop("k_four"), "name"),
    ]
    alike = named[0].select("key", "k_id").unionByName(named[1].select("key", "k_id")).unionByName(named[2].select("key", "k_id")).groupBy("key").agg(F.min("k_id").alias("k_id"))
    # the two least of different last fours, one of which differs from any
    w = W.partitionBy("slug", "name").orderBy("k_id")
    two = k.where("slug is not null and name is not null and k_four is not null").groupBy("slug", "name", "k_four").agg(F.min("k_id").alias("k_id")).withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    retyped = open_.join(two, ["slug", "name"]).where("four <> k_four").groupBy("key").agg(F.min("k_id").alias("k_id"))
    names = alike.select("key", F.lit("name").alias("signal"), "k_id").unionByName(retyped.select("key", F.lit("name").alias("signal"), "k_id"))
    open_ = open_.join(names.select("key"), "key", "left_anti")
    # equal last fours have been told above, so what is left is the same list for all of an institution
    listed = k.where("slug is not null and k_four is not null").withColumn("rn", F.row_number().over(W.partitionBy("slug").orderBy("k_id"))).where(F.col("rn") <= most)
    reissue = open_.where("four is not null").join(listed.select("slug", "k_id"), "slug").select("key", F.lit("institution_reissue").alias("signal"), "k_id")
    props = last4.unionByName(names).unionByName(reissue).groupBy("key").agg(F.min("signal").alias("signal"), F.array_sort(F.collect_set("k_id")).alias("proposals"))

    how = F.coalesce(*[F.when(F.col(f"by_{n}").isNotNull(), n) for n in hows], F.lit("minted"))
    return x.join(props, "key", "left").select("key", F.coalesce(strong, F.concat(F.lit("acc_"), T.sha16(F.col("key")))).alias("account_id"), how.alias("how"), "proposals", "signal")


def prefer_exact(fuzzy: DataFrame, exact: DataFrame) -> DataFrame:
    """DOM16: (id, merchant_id): the provider's exact name beats the description's fuzzy match."""
    e = exact.select("id", F.col("merchant_id").alias("e"))
    return fuzzy.select("id", F.col("merchant_id").alias("f")).join(e, "id", "full_outer").select("id", F.coalesce("e", "f").alias("merchant_id"), F.col("e").isNotNull().alias("exact"))


def resolve_merchants(incoming: DataFrame, bindings: DataFrame, known: DataFrame, matches: DataFrame | None = None, pending: DataFrame | None = None, rejected: DataFrame | None = None) -> DataFrame:
    """DOM20: (ref, name) to an action and a merchant: adopt a binding; bind an equal name; propose the
    weaker match, (ref, merchant_id) in ``matches``, of which the least id counts; else mint.  A ref in ``pending`` is
    neither bound nor minted: its match is proposed and without one nothing is done.  A match in
    ``rejected`` (ref, merchant_id) counts as none.  A null ref is left alone."""
    x = incoming.join(bindings.groupBy("ref").agg(F.min("merchant_id").alias("bound")), "ref", "left")
    k = known.groupBy(T.alias_key(F.col("name")).alias("k_key")).agg(F.min("merchant_id").alias("equal"))
    x = x.withColumn("key", T.alias_key(F.col("name"))).join(k, F.col("key") == F.col("k_key"), "left")
    weak = F.lit(None).cast(known.schema["merchant_id"].dataType).alias("weak")
    x = x.select("*", weak) if matches is None else x.join(matches.groupBy("ref").agg(F.min("merchant_id").alias("weak")), "ref", "left")
    x = x.withColumn("match", F.coalesce("equal", "weak")).withColumn("exact", F.col("equal").isNotNull())
    if rejected is not None:
        no = rejected.select("ref", F.col("merchant_id").alias("match"), F.lit(True).alias("no")).distinct()
        x = x.join(no, ["ref", "match"], "left").withColumn("match", F.when(F.col("no").isNull(), F.col("match")))
    x = x.withColumn("review", F.lit(False)) if pending is None else x.join(pending.select("ref", F.lit(True).alias("review")).distinct(), "ref", "left")
    review = F.coalesce("review", F.lit(False))
    action = F.when(F.col("ref").isNull(), "none").when(F.col("bound").isNotNull(), "adopt").when(F.col("match").isNotNull() & F.col("exact") & ~review, "bind")
    x = x.withColumn("action", action.when(F.col("match").isNotNull(), "propose").when(review, "none").otherwise("mint"))
    # names of nothing but signs are one placeholder each, never one merchant
    minted = F.concat(F.lit("mer_"), T.sha16(F.when(F.col("key") != "", F.col("key")).otherwise(F.concat(F.lit("ref "), F.col("ref").cast("string")))))
    return x.select("ref", "action", F.when(F.col("action") == "mint", minted).when(F.col("action") != "none", F.coalesce("bound", "match")).alias("merchant_id"))


def close_names(wanted: DataFrame, known: DataFrame, cutoff: float = 0.85, most: int = 3) -> DataFrame:
    """The ``most`` names of ``known`` (k_name) nearest to each of ``wanted`` (name), by Ratcliff and Obershelp's ratio, none below
    the cutoff.

    What matches is a common subsequence: of m characters, of t of both, at least 3 m - t - 1 bigrams are
    common, which is over 0 for all names if the cutoff is over 5/6.  So only names that share so many are compared, and none is lost."""
    if cutoff <= 5 / 6:
        raise ValueError("the bound on common bigrams needs a cutoff above 5/6")

    def grams(t: DataFrame, c: str) -> DataFrame:
        x = t.select(c).where(F.length(c) > 0).distinct()
        # the whole name stands for those too short to have a bigram
        g = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substr(F.col(c), i, F.lit(2)))
        x = x.select(c, F.posexplode(g).alias("i", "gram"))
        return x.select(c, "gram", F.row_number().over(W.partitionBy(c, "gram").orderBy("i")).alias("nth"))

    common = grams(wanted, "name").join(grams(known, "k_name"), ["gram", "nth"]).groupBy("name", "k_name").agg(F.count("*").alias("n"))
    total = F.length("name") + F.length("k_name")
    short = 2 * F.least(F.length("name"), F.length("k_name")) >= cutoff * total - 1e-9
    x = common.where(short & (F.col("n") >= F.greatest((1.5 * cutoff - 1) * total - 1 - 1e-9, F.lit(1.0))))
    x = x.withColumn("ratio", T.ratio("k_name", "name")).where(F.col("ratio") >= cutoff)
    best = F.row_number().over(W.partitionBy("name").orderBy(F.desc("ratio"), F.desc("k_name")))
    return x.withColumn("rank", best).where(F.col("rank") <= most).select("name", "k_name")


def _plain(c: str) -> Column:
    return F.nullif(F.upper(F.trim(F.col(c))), F.lit(""))


def resolve_securities(incoming: DataFrame, refs: DataFrame, known: DataFrame, pending: DataFrame | None = None, rejected: DataFrame | None = None, unreviewed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """DOM50: (ref, cusip, isin, ticker, mic, name) to (ref, how, security_id) and proposals (ref, security_id, reason).

    A bound reference is adopted; one in ``pending`` waits, with no security; else CUSIP, then ISIN, then a
    unique equal ticker binds.  An identifier that several securities hold is a tie: it ends the ladder and
    proposes all of them.  An equal ticker of another exchange, or of the part before the first point or
    dash, is only proposed.  What binds nothing is minted as provisional, and if nothing of the above is
    proposed, the three nearest names from 0.85 are.  A security whose CUSIP or ISIN differs is
    never bound and never proposed; neither are pairs in ``rejected`` (ref, security_id) nor securities in ``unreviewed``
    proposed.  Refs are expected once each; case and blanks around identifiers do not count."""
    ids = ("cusip", "isin", "ticker", "mic")
    named = lambda t: _plain("name") if "name" in t.columns else F.lit(None).cast("string")
    x = incoming.select("ref", *[_plain(c).alias(c) for c in ids], named(incoming).alias("name"))
    k = known.select(F.col("security_id").alias("k_id"), *[_plain(c).alias(f"k_{c}") for c in ids], named(known).alias("k_name"))
    x = x.join(refs.groupBy("ref").agg(F.min("security_id").alias("bound")), "ref", "left")
    x = x.withColumn("waits", F.lit(False)) if pending is None else x.join(pending.select("ref", F.lit(True).alias("waits")).distinct(), "ref", "left")
    for c in ids[:3]:
        hit = k.where(F.col(f"k_{c}").isNotNull()).groupBy(F.col(f"k_{c}").alias(c)).agg(F.count("*").alias(f"{c}_n"), F.min(F.struct("k_id", "k_cusip", "k_isin", "k_mic")).alias(f"{c}_hit"))
        x = x.join(hit, c, "left")
    differ = lambda a, b: F.coalesce(a != b, F.lit(False))
    other = lambda p: differ(F.col("cusip"), F.col(f"{p}k_cusip")) | differ(F.col("isin"), F.col(f"{p}k_isin"))
    one = lambda c: (F.col(f"{c}_n") == 1) & ~other(f"{c}_hit.")
    abroad = differ(F.col("mic"), F.col("ticker_hit.k_mic"))
    rung = F.when(F.col("bound").isNotNull(), "bound").when(F.coalesce("waits", F.lit(False)), "pending")
    for c in ids[:2]:
        rung = rung.when(F.col(f"{c}_n") > 1, f"tie {c}").when(one(c), c)
    rung = rung.when(F.col("ticker_n") > 1, "tie ticker").when(one("ticker"), F.when(abroad, "abroad").otherwise("ticker"))
    rung = rung.when(F.col("ticker_n").isNull() & F.col("ticker").rlike("[.-]"), "suffix").otherwise("none")
    x = x.withColumn("rung", rung).withColumn("stem", F.regexp_extract("ticker", r"^[^.-]*", 0))

    def to(rung: str, on: Column, reason: str) -> DataFrame:
        return x.where(F.col("rung") == rung).join(k, on).where(~other("")).select("ref", F.col("k_id").alias("security_id"), F.lit(reason).alias("reason"))

    def offered(t: DataFrame) -> DataFrame:
        t = t if rejected is None else t.join(rejected, ["ref", "security_id"], "left_anti")
        return t if unreviewed is None else t.join(unreviewed, "security_id", "left_anti")

    flagged = to("abroad", F.col("ticker") == F.col("k_ticker"), "exchange_contradiction").unionByName(to("suffix", F.col("stem") == F.col("k_ticker"), "ticker_suffix_strip"))
    for c in ids[:3]:
        flagged = flagged.unionByName(to(f"tie {c}", F.col(c) == F.col(f"k_{c}"), "identifier_tie"))
    flagged = offered(flagged)
    proposals = flagged
    if "name" in incoming.columns and "name" in known.columns:
        open_ = x.where(F.col("rung").rlike("^(tie|abroad|suffix|none)")).join(flagged.select("ref").distinct(), "ref", "left_anti")
        near = open_.join(close_names(open_, k), "name").join(k, "k_name").where(~other(""))
        proposals = flagged.unionByName(offered(near.select("ref", F.col("k_id").alias("security_id"), F.lit("fuzzy_name").alias("reason"))))
    binds = ("bound", "pending", *ids[:3])
    how = F.when(F.col("rung").isin(*binds), F.col("rung")).otherwise("provisional")
    chosen = F.when(F.col("rung") == "bound", F.col("bound"))
    for c in ids[:3]:
        chosen = chosen.when(F.col("rung") == c, F.col(f"{c}_hit.k_id"))
    chosen = chosen.when(~F.col("rung").isin(*binds), F.concat(F.lit("sec_"), T.sha16(F.col("ref"))))
    return x.select("ref", how.alias("how"), chosen.alias("security_id")), proposals.select("ref", "security_id", "reason")


def opening_gaps(snapshots: DataFrame, ledger: DataFrame) -> DataFrame:
    """DOM26: (account_id, security_id, date, quantity) first seen, less what the ledger explains until then."""
    w = W.partitionBy("account_id", "security_id").orderBy("date")
    first = snapshots.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    l = ledger.select(F.col("account_id").alias("a"), F.col("security_id").alias("s"), F.col("date").alias("d"), F.col("quantity").alias("q"))
    x = first.join(l, (F.col("account_id") == F.col("a")) & (F.col("security_id") == F.col("s")) & (F.col("d") <= F.col("date")), "left")
    x = x.groupBy("account_id", "security_id", "date", "quantity").agg(F.coalesce(F.sum("q"), F.lit(0)).alias("explained"))
    return x.withColumn("gap", F.col("quantity") - F.col("explained"))


def opening_lots(gaps: DataFrame, claims: DataFrame) -> DataFrame:
    """DOM27: a gap is drawn from the claimed lots (date, quantity, basis), those without a date last, the
    oldest first; the lot at the boundary in proportion; what no lot covers is one lot without basis."""
    by = W.partitionBy("account_id", "security_id").orderBy(F.col("lot_date").isNull(), "lot_date", "lot_index")
    c = claims.withColumn("upto", F.sum("lot_quantity").over(by.rowsBetween(W.unboundedPreceding, 0)))
    x = c.join(gaps.where("gap > 0").select("account_id", "security_id", "date", "gap"), ["account_id", "security_id"])
    take = F.least(F.col("lot_quantity"), F.col("gap") - (F.col("upto") - F.col("lot_quantity")))
    x = x.withColumn("take", take).where("take > 0")
    basis = (F.col("lot_basis").cast("double") * F.col("take").cast("double") / F.col("lot_quantity").cast("double")).cast("decimal(18,2)")
    drawn = x.select("account_id", "security_id", F.coalesce("lot_date", "date").alias("date"), F.col("take").cast("decimal(18,2)").alias("quantity"), basis.alias("basis"))
    covered = x.groupBy("account_id", "security_id").agg(F.sum("take").alias("covered"))
    rest = gaps.where("gap > 0").join(covered, ["account_id", "security_id"], "left").withColumn("left", F.col("gap") - F.coalesce("covered", F.lit(0))).where("left > 0")
    return drawn.unionByName(rest.select("account_id", "security_id", "date", F.col("left").cast("decimal(18,2)").alias("quantity"), F.lit(None).cast("decimal(18,2)").alias("basis")))


def opening_review(gaps: DataFrame, claims: DataFrame) -> DataFrame:
    """DOC07: openings that no lot accounts for: the ledger explains more than is held, no claim has a
    date or quantity to draw on, or the claims do not cover the gap."""
    c = claims.groupBy("account_id", "security_id").agg(F.sum("lot_quantity").alias("claimed"))
    x = gaps.join(c, ["account_id", "security_id"], "left")
    reason = F.when(F.col("gap") < 0, "oversold").when((F.col("gap") > 0) & F.col("claimed").isNull(), "no lots").when(F.col("gap") > F.col("claimed"), "not covered")
    return x.withColumn("reason", reason).where("reason is not null").select("account_id", "security_id", "reason")


def model_freshness(runs: DataFrame, now: str) -> DataFrame:
    """DOM48: the last run of each model and version, and its age in hours."""
    x = runs.groupBy("model").agg(F.max_by("version", "finished_at").alias("version"), F.max("finished_at").alias("finished_at"))
    return x.withColumn("hours", F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("finished_at").cast("timestamp"))) / 3_600_000_000).cast("long"))
