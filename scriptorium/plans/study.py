"""Tables of the study application for queries, and the same as SQL.

Books, anchors and highlights aren't among the stored tables; they are projections of verses and events, whole.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import corpus
from scriptorium.session import ready, table

#: The translation that is being read.
ACTIVE = 1
#: Keys of the stored tables.
KEYS = {"verses": ["translation_id", "verse_id"], "tokens": ["token_id"], "notes": ["note_id"], "jobs": ["job_id"], "extractions": ["extraction_id"], "pages": ["page_id"], "spans": ["span_id"]}


class Study:
    """The tables of one folder; every stored row once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = ready(spark), folder

    def table(self, name: str, *keys: str) -> DataFrame:
        df = table(self.spark, self.folder, name)
        return df.dropDuplicates(list(keys)) if keys else df

    def some(self, name: str, condition) -> DataFrame:
        """Rows of a table that meet a condition, each once; the condition comes first, so that it reaches the scan."""
        return self.table(name).where(condition).dropDuplicates(KEYS[name])

    @cached_property
    def translations(self) -> DataFrame:
        return self.table("translations")

    @cached_property
    def verses(self) -> DataFrame:
        return self.table("verses", "translation_id", "verse_id")

    @cached_property
    def tokens(self) -> DataFrame:
        return self.table("tokens", "token_id")

    @cached_property
    def notes(self) -> DataFrame:
        return self.table("notes", "note_id")

    @cached_property
    def jobs(self) -> DataFrame:
        return self.table("jobs", "job_id")

    @cached_property
    def extractions(self) -> DataFrame:
        return self.table("extractions", "extraction_id")

    @cached_property
    def pages(self) -> DataFrame:
        return self.table("pages", "page_id")

    @cached_property
    def spans(self) -> DataFrame:
        return self.table("spans", "span_id")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def books(self) -> DataFrame:
        return corpus.books_of(self.table("verses"))

    @cached_property
    def book(self) -> str:
        """The book that chapter queries read: the last one by code."""
        return self.table("verses").agg(F.max("book_osis")).first()[0]

    @cached_property
    def book_count(self) -> int:
        return self.table("verses").agg(F.countDistinct("book_osis")).first()[0]

    def _annotations(self, number: str, verse: str) -> DataFrame:
        e = self.events.withColumn("n", F.expr(f"{number} % {max(1, self.book_count)} + 1"))
        b = self.books.select("osis", F.col("canonical_order").alias("n"))
        return e.join(F.broadcast(b), "n").withColumn("verse_id", F.concat_ws(".", "osis", F.lit("1"), F.expr(f"cast({verse} as string)")))

    @cached_property
    def anchors(self) -> DataFrame:
        word = F.col("event_id") % 4 == 2
        return self._annotations("(user_id * user_id + event_id % 3)", "user_id % 5 + 1").select(
            F.col("event_id").alias("id"), F.col("event_id").alias("note_id"), F.when(word, "word").otherwise("verse").alias("anchor_type"), "verse_id", F.when(word, 1 + F.col("user_id") % 4).alias("translation_id"), F.when(word, F.col("event_id") % 7).alias("token_idx"), F.when(word, F.col("event_type")).alias("surface"),
        )

    @cached_property
    def highlights(self) -> DataFrame:
        word = F.col("event_id") % 4 == 3
        return self._annotations("(event_id)", "user_id % 5 + 1").select(
            F.col("event_id").alias("id"), F.when(word, "word").otherwise("verse").alias("anchor_type"), "verse_id", F.when(word, 1 + F.col("user_id") % 4).alias("translation_id"), F.when(word, F.col("event_id") % 7).alias("token_idx"), F.col("event_type").alias("surface"), F.col("event_type").alias("color"), F.col("ts").alias("created_at"),
        )


#: The same tables as common table expressions, by name; each may use those before it.
CTES = {
    "v": "SELECT DISTINCT * FROM verses",
    "tok": "SELECT DISTINCT * FROM tokens",
    "n": "SELECT DISTINCT * FROM notes",
    "j": "SELECT DISTINCT * FROM jobs",
    "x": "SELECT DISTINCT * FROM extractions",
    "pg": "SELECT DISTINCT * FROM pages",
    "sp": "SELECT DISTINCT * FROM spans",
    "d": "SELECT * FROM documents",
    "t": "SELECT * FROM translations",
    "books": "SELECT osis, row_number() OVER (ORDER BY osis) AS canonical_order, 'Book of ' || osis AS name, CASE WHEN row_number() OVER (ORDER BY osis) * 2 <= count(*) OVER () THEN 'OT' ELSE 'NT' END AS testament FROM (SELECT DISTINCT book_osis AS osis FROM verses)",
    "a": """SELECT event_id AS id, event_id AS note_id, CASE WHEN event_id % 4 = 2 THEN 'word' ELSE 'verse' END AS anchor_type, osis || '.1.' || CAST(user_id % 5 + 1 AS VARCHAR) AS verse_id,
      CASE WHEN event_id % 4 = 2 THEN 1 + user_id % 4 END AS translation_id, CASE WHEN event_id % 4 = 2 THEN event_id % 7 END AS token_idx, CASE WHEN event_id % 4 = 2 THEN event_type END AS surface
      FROM events JOIN books ON canonical_order = (user_id * user_id + event_id % 3) % (SELECT count(*) FROM books) + 1""",
    "h": """SELECT event_id AS id, CASE WHEN event_id % 4 = 3 THEN 'word' ELSE 'verse' END AS anchor_type, osis || '.1.' || CAST(user_id % 5 + 1 AS VARCHAR) AS verse_id,
      CASE WHEN event_id % 4 = 3 THEN 1 + user_id % 4 END AS translation_id, CASE WHEN event_id % 4 = 3 THEN event_id % 7 END AS token_idx, event_type AS surface, event_type AS color, ts AS created_at
      FROM events JOIN books ON canonical_order = event_id % (SELECT count(*) FROM books) + 1""",
}
_NEEDS = {"a": ["books"], "h": ["books"]}


def sql(select: str, *names: str) -> str:
    """A query with the tables it names (those they need come first)."""
    wanted: list[str] = []
    for name in names:
        for x in (*_NEEDS.get(name, []), name):
            if x not in wanted:
                wanted.append(x)
    head = ", ".join(f"{x} AS ({CTES[x]})" for x in wanted)
    body = select.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}" if head else body
    return f"WITH {head} {body}" if head else body
