"""Exact quantiles whose tasks hold no group's values: each group's distinct values are cut into parts, counts name the parts that hold the ranks, and only those are ordered."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a group's values are cut into, and the buckets of hash that each give a value to choose the cuts from.
PARTS, BUCKETS = 64, 1_024
#: Tasks that a group's distinct values are dealt to where they meet its cuts.
SHARES = 16


def exact(rows: DataFrame, by: Sequence[str], value: str, wanted: Mapping[str, tuple[float, str]]) -> DataFrame:
    """(by, names): a row per group with a value; wanted names quantiles, each a share and "linear" or "nearest" (rank ceil(p n)).

    Nulls don't count. Rows are only counted by value, on the map side; all else goes over distinct values, which no
    group's size puts into one task; the cuts are SHARES rows per group. Groups are told apart with nulls as a group of their own.
    Cuts follow from the values alone, as a plan or a task run again may work them out twice (a sketch's follow from the
    order in which rows meet); parts are found again by their least and most values.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    rows = rows.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(value).alias("_x")).where("_x IS NOT NULL")
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys] or [F.lit(True)]
    counts = rows.groupBy(*keys, "_x").agg(F.count("*").alias("_c"))
    tried = counts.groupBy(*keys, F.pmod(F.xxhash64("_x"), F.lit(BUCKETS)).alias("_bucket")).agg(F.sum("_c").alias("_n"), F.min_by("_x", F.xxhash64("_x")).alias("_x"))
    tried = tried.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.sort_array(F.collect_list("_x")).alias("_tried"))
    every = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("_share")
    spread = [F.get("_tried", F.floor(F.size("_tried") * k / PARTS).cast("int")) for k in range(1, PARTS)]
    cuts = tried.select(*keys, "_n", F.array_distinct(F.array(*spread)).alias("_cuts"), every)
    part = F.size(F.filter("_cuts", lambda c: c < F.col("_x")))
    counts = counts.withColumn("_share", F.coalesce(F.pmod(F.xxhash64("_x"), F.lit(SHARES)).cast("int"), F.lit(0)))
    dealt = counts.alias("r").join(cuts.alias("c"), [*same("r", "c"), F.col("r._share") == F.col("c._share")]).select(*[f"r.{k}" for k in keys], "_x", "_c", "_n", part.alias("_part"))
    # how many values come before each part, what it lies between, and the parts that the ranks fall into
    sizes = dealt.groupBy(*keys, "_part").agg(F.sum("_c").alias("_m"), F.max("_n").alias("_n"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
    run = Window.partitionBy(*keys, F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_m").over(run), F.lit(0)))
    spots = [(name, end, _rank(p, kind, end)) for name, (p, kind) in wanted.items() for end in (0, 1)]
    spots = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(end).alias("end"), rank.alias("rank")) for name, end, rank in spots])
    inside = sizes.withColumn("_all", F.filter(spots, lambda s: (s["rank"] >= F.col("_before")) & (s["rank"] < F.col("_before") + F.col("_m")))).where(F.size("_all") > 0)
    inside = inside.select(*keys, "_part", "_least", "_most", "_before", "_n", "_all", every)
    few = counts.alias("r").join(inside.alias("c"), [*same("r", "c"), F.col("r._share") == F.col("c._share"), F.col("_x") >= F.col("_least"), F.col("_x") <= F.col("_most")])
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy("_x"))
    few = few.select(*[f"r.{k}" for k in keys], "_part", "_x", "_c", "_before", "_n", "_all").withColumn("_upto", F.col("_before") + upto)
    found = few.select(*keys, "_n", "_x", F.explode(F.filter("_all", lambda s: (s["rank"] < F.col("_upto")) & (s["rank"] >= F.col("_upto") - F.col("_c")))).alias("_s"))

    def one(name: str, p: float) -> Column:
        low, high = (F.max(F.when((F.col("_s.name") == name) & (F.col("_s.end") == e), F.col("_x"))) for e in (0, 1))
        at = F.lit(p) * (F.max("_n") - 1)
        return F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at)))

    out = found.groupBy(*keys).agg(*[(one(name, p) if kind == "linear" else F.max(F.when(F.col("_s.name") == name, F.col("_x")))).alias(name) for name, (p, kind) in wanted.items()])
    return out.select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], *wanted)


def described(rows: DataFrame, by: Sequence[str], value: str, wanted: Mapping[str, tuple[float, str]]) -> DataFrame:
    """(by, n, mean, std, least, most, names): one pass for columns of few distinct values, such as lengths and counts.

    Values are counted on the map side; a group's distinct values, not its rows, meet in one task. As exact() otherwise.
    """
    own = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_x")).agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_upto", F.sum("_c").over(own.orderBy("_x"))).withColumn("_n", F.sum("_c").over(own))
    counts = counts.withColumn("_mean", F.sum(F.col("_x") * F.col("_c")).over(own) / F.col("_n"))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto")), F.col("_x")))

    out = []
    for name, (p, kind) in wanted.items():
        if kind == "nearest":
            out.append(at(_rank(p, kind, 0)).alias(name))
            continue
        low, high, spot = at(_rank(p, kind, 0)), at(_rank(p, kind, 1)), F.lit(p) * (F.max("_n") - 1)
        out.append((low + (high - low) * (spot - F.floor(spot))).alias(name))
    off = F.col("_x") - F.col("_mean")
    std = F.sqrt(F.try_divide(F.sum(off * off * F.col("_c")), F.max("_n") - 1))
    plain = [F.max("_n").alias("n"), F.max("_mean").alias("mean"), std.alias("std"), F.min("_x").alias("least"), F.max("_x").alias("most")]
    return counts.groupBy(*by).agg(*plain, *out)


def _rank(p: float, kind: str, end: int) -> Column:
    if kind == "nearest":
        return F.greatest(F.ceil(F.round(F.lit(p) * F.col("_n"), 9)) - 1, F.lit(0)).cast("long")
    at = F.lit(p) * (F.col("_n") - 1)
    return (F.ceil(at) if end else F.floor(at)).cast("long")
