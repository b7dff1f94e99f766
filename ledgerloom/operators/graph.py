"""JON08, DOM06: connected components by alternating large and small stars; JON20, DOC02: overlaps."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import scratch_dir


#: Ids that a task joins in memory before it hands on their stars.
NODES = 1 << 18


def snapshot(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared checkpoint folder."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _stars(edges: DataFrame) -> DataFrame:
    """(u, v) to stars (u, v), v the least id, that join the same ids: each task joins its own edges, at
    most about ``NODES`` ids at a time."""
    most = NODES

    def run(batches):
        up = {}

        def root(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        def stars(kind):
            found = [(i, r) for i in up if (r := root(i)) != i]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k in (0, 1)], names=["u", "v"])

        kind = None
        for batch in batches:
            kind = batch.schema.field("u").type
            for u, v in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                p, q = root(up.setdefault(u, u)), root(up.setdefault(v, v))
                if p != q:
                    up[max(p, q)] = min(p, q)
            if len(up) >= most:
                yield stars(kind)
                up.clear()
        if up:
            yield stars(kind)

    x = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return x.mapInArrow(run, x.schema)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) undirected to (id, comp): the least id that can be reached, for each id of an edge; an
    error where that takes more rounds.
    Tasks first join the edges they hold.  Where no id is in two of their stars, these are the components; else
    rounds follow, in which hubs are pre-aggregated by the grouped minimum, so no neighbourhood is ever gathered."""
    e = snapshot(_stars(edges))
    each = e.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(e.select("v", "v"))
    each = snapshot(each.groupBy("id").agg(F.min("comp").alias("comp"), F.max("comp").alias("other")))
    if each.where("comp <> other").isEmpty():
        return each.select("id", "comp")
    e = snapshot(e.distinct())
    mark = lambda: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    state = mark()
    for _ in range(rounds):
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        up = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = snapshot(down.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = mark()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(e.select("v", "v")).distinct()


def overlaps(rows: DataFrame, once: DataFrame | None = None, long: int = 64) -> DataFrame:
    """(account_id, priority, transaction_date) to (a, b, days): accounts a < b that share rows on two days or
    more, and on how many; of the accounts ``once`` (account_id) also as a with those that share one.

    Accounts of equal rows are compared as one class and expanded at the end.  Classes meet on pairs of
    their own days, so that each meeting is part of an answer; those of more than ``long`` rows, whose pairs
    are many, meet the others row by row."""
    row = F.struct(F.col("transaction_date").alias("d"), F.col("priority").alias("p"))
    held = rows.where("priority is not null and transaction_date is not null and account_id is not null").groupBy("account_id").agg(F.array_sort(F.collect_set(row)).alias("rows"))
    held = snapshot(held.withColumn("c", F.min("account_id").over(W.partitionBy("rows"))))
    members = held.select("account_id", "c")
    classes = held.where("account_id = c").select("c", "rows")
    each = classes.select("c", F.explode("rows").alias("x"), F.size("rows").alias("k")).select("c", "k", F.col("x.d").alias("d"), F.col("x.p").alias("p"))
    other = each.select(F.col("c").alias("o"), F.col("k").alias("ok"), "d", "p")

    two = F.flatten(F.transform("rows", lambda x: F.transform(F.filter("rows", lambda y: y["d"] > x["d"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    pairs = classes.where(F.size("rows") <= long).select("c", F.explode(two).alias("q")).select("c", *[F.col(f"q.{i}.{j}").alias(i + j) for i in "xy" for j in "dp"])
    met = pairs.join(pairs.withColumnRenamed("c", "o"), ["xd", "xp", "yd", "yp"]).where("c < o")
    light = met.groupBy("c", "o").agg(F.countDistinct("xd", "yd").alias("n")).select("c", "o", F.round((1 + F.sqrt(1 + 8 * F.col("n"))) / 2).cast("long").alias("days"))
    meet = lambda some: some.join(other, ["d", "p"]).where("c <> o")
    heavy = meet(each.where(F.col("k") > long)).where((F.col("ok") <= long) | (F.col("c") < F.col("o"))).groupBy("c", "o").agg(F.countDistinct("d").alias("days")).where("days >= 2")
    own = classes.select("c", F.col("c").alias("o"), F.size(F.array_distinct(F.transform("rows", lambda x: x["d"]))).cast("long").alias("days"))

    left, right = members.select(F.col("account_id").alias("l"), "c"), members.select(F.col("account_id").alias("r"), F.col("c").alias("o"))
    out = light.union(heavy).union(own.where("days >= 2")).join(left, "c").join(right, "o").where("c <> o or l < r")
    out = out.select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"), "days")
    if once is not None:
        some = left.join(once.select(F.col("account_id").alias("l")), "l", "left_semi")
        single = meet(each.join(some.select("c").distinct(), "c", "left_semi")).groupBy("c", "o").agg(F.countDistinct("d").alias("days")).union(own).where("days = 1")
        out = out.union(single.join(some, "c").join(right, "o").where("l < r").select("l", "r", "days"))
    return out
