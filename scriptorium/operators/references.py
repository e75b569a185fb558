"""Typed references such as "1 Cor 13:4" resolved against the books that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import ALIASES, normalize_reference, strip_space

#: The form of a typed reference, "<book> <chapter>[:<verse>]".
REFERENCE = r"(?U)^(.+?)[\s.]*([0-9]+)(?:\s*[:.\s]\s*([0-9]+))?\s*$"


def match_books(queries: DataFrame, column: str, books: DataFrame) -> DataFrame:
    """Adds osis: by alias, else exactly, else by a prefix that only one book has. Books are a fixed dimension (a canon).

    Three ranked equi-joins: prefixes of the books are listed, so no pair of query and book is ever compared.
    """
    b = books.select("osis", normalize_reference(F.col("osis")).alias("code"), normalize_reference(F.col("name")).alias("full"))
    spark = queries.sparkSession
    alias = spark.createDataFrame(sorted(ALIASES.items()), "q string, alias string").join(b.select(F.col("osis").alias("by_alias")), F.lower("alias") == F.lower("by_alias")).groupBy("q").agg(F.min("by_alias").alias("by_alias"))
    exact = b.select(F.explode(F.array("code", "full")).alias("q"), "osis").groupBy("q").agg(F.min("osis").alias("by_name"))
    starts = b.select("osis", F.explode(F.array("code", "full")).alias("t")).where(F.length("t") > 0).select("osis", "t", F.explode(F.sequence(F.lit(1), F.length("t"))).alias("n")).select("osis", F.col("t").substr(F.lit(1), F.col("n")).alias("q"))
    prefix = starts.distinct().groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("osis").alias("by_prefix")).where("n = 1").drop("n")
    q = queries.withColumn("q", normalize_reference(F.col(column)))
    for side in (alias, exact, prefix):
        q = q.join(F.broadcast(side), "q", "left")
    return q.withColumn("osis", F.when(F.col("q") != "", F.coalesce("by_alias", "by_name", "by_prefix"))).drop("q", "by_alias", "by_name", "by_prefix")


def parse_references(queries: DataFrame, column: str, books: DataFrame) -> DataFrame:
    """Adds book, chapter, verse; all null if the book can't be told or has no such chapter. A book alone is chapter 1."""
    text = strip_space(F.col(column))
    hit = text.rlike(REFERENCE)
    parts = queries.withColumn("__book", F.when(hit, F.regexp_extract(text, REFERENCE, 1)).otherwise(text))
    parts = parts.withColumn("__chapter", F.when(hit, F.regexp_extract(text, REFERENCE, 2).try_cast("long")).otherwise(F.lit(1)))
    parts = parts.withColumn("__verse", F.when(hit, F.regexp_extract(text, REFERENCE, 3).try_cast("long")))
    found = match_books(parts, "__book", books).join(F.broadcast(books.select(F.col("osis").alias("__osis"), "chapter_count")), F.col("osis") == F.col("__osis"), "left")
    ok = F.col("osis").isNotNull() & (F.col("__chapter") >= 1) & (F.col("__chapter") <= F.col("chapter_count")) | (F.col("osis").isNotNull() & ~hit)
    keep = [c for c in queries.columns]
    return found.select(*keep, F.when(ok, F.col("osis")).alias("book"), F.when(ok, F.col("__chapter")).alias("chapter"), F.when(ok & (F.col("__verse") > 0), F.col("__verse")).alias("verse"))
