"""Splits and samples by hash, so that members don't depend on order, partitions or other rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlsieve.functions import text


def share(key: Column, salt: str) -> Column:
    """A number from 0 to 99 that depends on the key and the salt alone."""
    return text.hash_prefix(F.concat(F.lit(salt), key)) % 100


def by_group(rows: DataFrame, group: str, test: int = 20, salt: str = "42:", column: str = "part") -> DataFrame:
    """rows with "test" for about `test` percent of the groups and "train" for the others; a group is never cut."""
    return rows.withColumn(column, F.when(share(F.col(group), salt) < test, "test").otherwise("train"))


def folds(rows: DataFrame, group: str, k: int = 3, salt: str = "42:", column: str = "fold") -> DataFrame:
    return rows.withColumn(column, (text.hash_prefix(F.concat(F.lit(salt), F.col(group))) % k).cast("int"))


def overlap(rows: DataFrame, group: str, column: str = "part") -> DataFrame:
    """Groups that stand in both parts; must be empty."""
    return rows.where(F.col(column) == "train").select(group).intersect(rows.where(F.col(column) == "test").select(group))


#: Letters of a hash that a round of counting looks at.
LETTERS = 3


def sample(rows: DataFrame, n: int, key: str, seed: str = "42:") -> DataFrame:
    """n rows without replacement, those whose key's hash is least, equal ones by key; all rows if there are no more.

    Counts by the hash's first letters, then by the next ones inside the part in which the n-th row falls, find where to cut:
    rows are filtered, not sorted, but for those whose hash equals the last one's. Counting runs when this is called.
    """
    hashed = rows.withColumn("_hash", F.md5(F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    prefix, need, inside = "", n, None
    while inside is None or inside > need and len(prefix) < 32:
        own = hashed.where(F.col("_hash").startswith(prefix)).groupBy(F.substring("_hash", len(prefix) + 1, LETTERS).alias("next")).count()
        before = 0
        for part, m in sorted(tuple(r) for r in own.collect()):
            if before + m >= need:
                prefix, need, inside = prefix + part, need - before, m
                break
            before += m
        else:
            return rows
    low = hashed.where(F.col("_hash") < prefix)
    last = hashed.where(F.col("_hash").startswith(prefix))
    if inside > need:
        last = last.withColumn("_rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_hash", key))).where(F.col("_rank") <= need).drop("_rank")
    return low.union(last).drop("_hash")


def _dealt(loads: list[int], size: int, groups: int) -> list[int]:
    """How many of so many groups of one size each fold gets, if each in turn goes to the lightest fold, the first among equals."""

    def below(level: int) -> list[int]:
        return [max(0, -(-(level - x) // size)) for x in loads]

    low, high = min(loads), max(loads) + size * (groups + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if sum(below(mid)) <= groups else (low, mid - 1)
    out = below(low)
    left = groups - sum(out)
    for f, x in enumerate(loads):
        if left and x + out[f] * size == low:
            out[f] += 1
            left -= 1
    return out


def balanced_folds(rows: DataFrame, group: str, k: int = 3, column: str = "fold") -> DataFrame:
    """rows with a fold from 0 to k - 1, never cutting a group: the largest groups first, each to the fold with fewest rows, the first among equals.

    Groups of one size are dealt by their number in each fold, in order of key hash and key: sizes are counted, and of the
    sizes, of which there are few, the groups; so no task goes through all groups. A null group is one of its own. Counting
    runs when this is called.
    """
    sizes = rows.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    loads, bounds = [0] * k, []
    for size, groups in sorted((tuple(r) for r in sizes.groupBy("_n").count().collect()), reverse=True):
        dealt = _dealt(loads, size, groups)
        loads = [x + size * m for x, m in zip(loads, dealt, strict=True)]
        bounds.append((size, [sum(dealt[: f + 1]) for f in range(k)]))
    spark = rows.sparkSession
    if not bounds:
        return rows.withColumn(column, F.lit(None).cast("int"))
    name = F.coalesce(F.col("_g").cast("string"), F.lit(""))
    parts = sizes.withColumn("_part", (text.hash_prefix(name) % 4096).cast("int"))
    before = Window.partitionBy("_n").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("_n", "_part").agg(F.count("*").alias("m")).withColumn("_before", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    spot = F.row_number().over(Window.partitionBy("_n", "_part").orderBy("_g")) - 1 + F.col("_before")
    ends = spark.createDataFrame(bounds, "_n long, _ends array<long>")
    dealt = parts.join(counts, ["_n", "_part"]).withColumn("_spot", spot).join(ends, "_n")
    dealt = dealt.select("_g", F.size(F.filter("_ends", lambda e: e <= F.col("_spot"))).alias(column))
    return rows.join(dealt, rows[group].eqNullSafe(F.col("_g"))).drop("_g")


def leave_out(rows: DataFrame, source: str, cap: int = 600_000, source_col: str = "source", group: str = "domain", key: str = "id") -> DataFrame:
    """Training rows for testing on one source: other sources' rows, without its groups, at most cap of them."""
    held = rows.where(F.col(source_col) == source).select(group).distinct()
    return sample(rows.where(F.col(source_col) != source).join(held, group, "left_anti"), cap, key)


def outside(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct keys of rows that known lacks: none if rows are a subset."""
    return rows.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def even_sample(rows: DataFrame, n: int, key: str, width: int = 1 << 16) -> DataFrame:
    """Every k-th row in order of an integer key, n of them: row i * total div n for each i.

    Ordinals come from the sizes of key ranges, so that no task numbers all rows.
    """
    part = rows.withColumn("_part", F.floor(F.col(key) / width))
    sizes = part.groupBy("_part").agg(F.count("*").alias("m"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("_before"), F.sum("m").over(Window.partitionBy(F.lit(1))).alias("_total"))
    i = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1 + F.col("_before")
    spot = f"(({n} * _i + _total - 1) div _total)"  # the least k with k * total div n >= i
    out = part.join(sizes, "_part").withColumn("_i", i)
    return out.where(f"_total <= {n} OR {spot} < {n} AND ({spot} * _total) div {n} = _i").drop("_part", "_before", "_total", "_i")
