"""Changes of tables as pure functions of DataFrames: old table and change in, new table out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def insert_or_ignore(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` whose key the table lacks are added; keys may be null."""
    fresh = new.dropDuplicates(keys).alias("n")
    return table.unionByName(fresh.join(table, _same(fresh, table, keys), "left_anti"), allowMissingColumns=True)


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` replace those of the same key, others stay."""
    fresh = new.dropDuplicates(keys)
    return table.join(fresh, _same(table, fresh, keys), "left_anti").unionByName(fresh, allowMissingColumns=True)


def replace_group(table: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """All rows of a group that `new` has are deleted and its own inserted."""
    touched = new.select(*group).distinct()
    return table.join(touched, _same(table, touched, group), "left_anti").unionByName(new, allowMissingColumns=True)


def delete(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone, _same(table, gone, keys), "left_anti")


def update(table: DataFrame, change: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of rows that the change names take its values; the change has a row per key at most."""
    c = change.dropDuplicates([key]).select(F.col(key).alias("__key"), *[F.col(x).alias(f"__{x}") for x in columns])
    joined = table.join(c, table[key] == F.col("__key"), "left")
    return joined.select(*[F.when(F.col("__key").isNotNull(), F.col(f"__{x}")).otherwise(table[x]).alias(x) if x in columns else table[x] for x in table.columns])


def null_references(table: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    """References to deleted keys become null."""
    g = gone.select(F.col(key).alias("__gone")).distinct()
    joined = table.join(g, table[column] == F.col("__gone"), "left")
    return joined.select(*[F.when(F.col("__gone").isNull(), table[c]).alias(c) if c == column else table[c] for c in table.columns])


def next_ids(new: DataFrame, table: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Ids for new rows: the table's largest plus a running number in a total order; sorted by ranges, numbered per range."""
    top = table.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    ranges = new.orderBy(*order).withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    return number_rows(ranges, [], ["__range"], ["__at"], "__number").withColumn(key, F.lit(top) + F.col("__number")).drop("__range", "__at", "__number")


def upsert_latest(table: DataFrame, new: DataFrame, key: str, time: list[str]) -> DataFrame:
    """The last writer of a key wins: of several new rows the latest, and that one over the table's; columns as in the table."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*table.columns), F.struct(*time)).alias("__row")).select("__row.*")
    return upsert(table, last, [key])


def number_rows(rows: DataFrame, group: list[str], blocks: list[str], order: list[str], name: str) -> DataFrame:
    """Adds a running number from 1 within each group, in the order of blocks, then `order` (a total order).

    Rows are numbered within their block, and blocks by the sum of sizes before them: no task sorts a whole group, only
    its blocks and a list of block sizes.
    """
    own = F.row_number().over(Window.partitionBy(*group, *blocks).orderBy(*order))
    sizes = rows.groupBy(*group, *blocks).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    keys = [*group, *blocks]
    numbered = rows.withColumn("__own", own)
    o = offsets.select(*[F.col(k).alias(f"__{k}") for k in keys], "__offset")
    same = reduce(lambda a, b: a & b, [numbered[k].eqNullSafe(o[f"__{k}"]) for k in keys])
    return numbered.join(o, same, "left").select(*rows.columns, (F.col("__offset") + F.col("__own")).alias(name))


#: A key is hot if it has more than 1 / (HOT_PARTS * shuffle partitions) of all rows and at least HOT_ROWS.
HOT_PARTS, HOT_ROWS = 4, 20_000


def salted_join(rows: DataFrame, other: DataFrame, key: str, spread_by: list[str], hot: DataFrame | None = None) -> DataFrame:
    """Inner join on a key of which a few values may hold most of `rows`: those are dealt to all partitions by a hash of `spread_by`.

    `hot` is a cheaper frame with the same keys to count, else `rows`. At most HOT_PARTS * partitions keys can be hot, which
    bounds the list; rows of `other` are copied for hot keys only.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = (rows if hot is None else hot).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(f"n >= {HOT_ROWS}")
    found = counts.orderBy(F.desc("n")).limit(HOT_PARTS * parts).select(key).collect()
    keys = [r[0] for r in found]
    if not keys:
        return rows.join(other.hint("merge"), key)
    is_hot = F.col(key).isin(keys)
    left = rows.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(*spread_by), F.lit(parts))).otherwise(F.lit(0)).cast("int"))
    right = other.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right.hint("merge"), [key, "__salt"]).drop("__salt")


def index_errors(expected: Column, returned: Column) -> Column:
    """Why a set of returned indices isn't exactly the expected one; null if it is."""
    extra, missing = F.array_except(returned, expected), F.array_except(expected, returned)
    return F.when(F.size(extra) > 0, "extra").when(F.size(F.array_distinct(returned)) < F.size(returned), "twice").when(F.size(missing) > 0, "missing")
