"""References to records that are missing, deleted or late (problem 4).

References and parents are partitioned alike by (reference, key), sorted, and merged in one linear pass (a sort-merge
join). A parent stands for an interval of validity: from the time it was created to the time it was deleted. A reference is

- `missing` if the key has no parent row and no deletion,
- `deleted` if the key has a deletion, whether or not the parent row is still there,
- `late` if the parent was created after the reference's own time.

Keys that many references share are found by a count that is pre-aggregated, and split by salt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The HOT_PARTS * shuffle partitions most frequent keys are hot, if they have at least HOT_ROWS references.
HOT_PARTS, HOT_ROWS = 4, 20_000


@dataclass
class Reference:
    """One reference column: where it points, and how its rows are named and dated."""

    name: str
    rows: DataFrame
    key: Column
    row_key: Column
    own_time: Column
    period_time: Column
    parents: DataFrame
    parent_key: Column
    parent_time: Column
    deletions: DataFrame | None = None
    deleted_key: Column | None = None
    deleted_time: Column | None = None


def _sides(refs: list[Reference]) -> tuple[DataFrame, DataFrame]:
    children, parents = None, None
    for r in refs:
        c = r.rows.select(
            F.lit(r.name).alias("ref_name"), r.key.cast("long").alias("key"), r.row_key.cast("string").alias("row_key"), r.own_time.alias("own_time"), F.date_format(r.period_time, "yyyy-MM").alias("period")
        ).where("key IS NOT NULL")
        p = r.parents.select(F.lit(r.name).alias("ref_name"), r.parent_key.cast("long").alias("key"), r.parent_time.alias("created"), F.lit(None).cast("timestamp").alias("deleted"), F.lit(False).alias("gone"))
        if r.deletions is not None:
            d = r.deletions.select(F.lit(r.name).alias("ref_name"), r.deleted_key.cast("long").alias("key"), F.lit(None).cast("timestamp").alias("created"), r.deleted_time.alias("deleted"), F.lit(True).alias("gone"))
            p = p.unionByName(d)
        children = c if children is None else children.unionByName(c)
        parents = p if parents is None else parents.unionByName(p)
    return children, parents


def orphans(refs: list[Reference], partitions: int | None = None) -> DataFrame:
    """ref_name, period, row_key, key, reason of every reference that fails, each once however often it was delivered.

    Null keys refer to nothing and are left out. A row without an own time is never late; one without a period time has
    a null period. If a parent was delivered several times its earliest creation and deletion count. Empty sides give no
    rows, or `missing` ones. At most HOT_PARTS * partitions keys can be hot, which bounds the list that is broadcast.
    """
    children, parents = _sides(refs)
    spark = children.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = children.groupBy("ref_name", "key").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {HOT_ROWS}")
    hot = counts.orderBy(F.desc("n"), "ref_name", "key").limit(HOT_PARTS * parts).select("ref_name", "key", F.lit(True).alias("hot"))
    hot = spark.createDataFrame(hot.collect(), hot.schema)
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("row_key"), F.lit(parts))).otherwise(F.lit(0)).cast("int")
    left = children.join(F.broadcast(hot), ["ref_name", "key"], "left").withColumn("salt", salt).drop("hot")
    valid = parents.groupBy("ref_name", "key").agg(F.min("created").alias("created"), F.min("deleted").alias("deleted"), F.max("gone").alias("gone"))
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    right = valid.join(F.broadcast(hot), ["ref_name", "key"], "left").withColumn("salt", F.explode(copies)).drop("hot")
    merged = left.join(right.hint("merge"), ["ref_name", "key", "salt"], "left")
    reason = (
        F.when(F.col("gone"), "deleted")
        .when(F.col("gone").isNull(), "missing")
        .when(F.col("created") > F.col("own_time"), "late")
    )
    return merged.withColumn("reason", reason).where("reason IS NOT NULL").select("ref_name", "period", "row_key", "key", "reason").dropDuplicates(["ref_name", "row_key"])


def orphan_report(found: DataFrame) -> DataFrame:
    """ref_name, period, missing, deleted, late: counts per reference and period."""
    return found.groupBy("ref_name", "period").agg(*[F.count_if(F.col("reason") == r).alias(r) for r in ("missing", "deleted", "late")])
