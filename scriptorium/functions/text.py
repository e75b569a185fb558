"""Column functions on text: words with offsets, verse ids, references, display forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A word is letters and numbers, joined by apostrophes or hyphens.
WORD = r"[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*"
#: Short forms of book names that are no prefix of the full name.
ALIASES = {
    "ps": "Ps", "psalm": "Ps", "psalms": "Ps", "song": "Song", "songs": "Song", "sos": "Song", "canticles": "Song", "eccl": "Eccl", "ecc": "Eccl",
    "phil": "Phil", "philemon": "Phlm", "phlm": "Phlm", "rev": "Rev", "revelations": "Rev", "acts": "Acts", "jas": "Jas", "james": "Jas",
}
#: Ordinals before a book name.
ORDINALS = ((r"^(1st|first)\s+", "1 "), (r"^(2nd|second)\s+", "2 "), (r"^(3rd|third)\s+", "3 "), (r"^i\s+", "1 "), (r"^ii\s+", "2 "), (r"^iii\s+", "3 "))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """All words of a text."""
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def gaps(text: Column) -> Column:
    """What stands before, between and after the words; one more than there are words."""
    return F.split(text, WORD, -1)


def tokens(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys..., idx, surface, char_start, char_end (code points): offsets are sums of lengths so far, not searches.

    Null and empty texts have no tokens. One window per text; `keys` must identify it.
    """
    src = rows.where(F.col(text).isNotNull()).select(*keys, F.arrays_zip(words(F.col(text)).alias("w"), F.slice(gaps(F.col(text)), 1, F.size(words(F.col(text)))).alias("g")).alias("z"))
    each = src.select(*keys, F.posexplode("z").alias("idx", "p")).select(*keys, "idx", F.col("p.w").alias("surface"), F.col("p.g").alias("gap"))
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("gap") + F.length("surface")).over(w)
    return each.select(*keys, F.col("idx").cast("long").alias("idx"), "surface", (end - F.length("surface")).alias("char_start"), end.alias("char_end"))


def interleaved(text: Column) -> Column:
    """Gaps and words in turn; joined they give the text back."""
    g, w = gaps(text), words(text)
    pairs = F.transform(F.arrays_zip(g.alias("g"), w.alias("w")), lambda p: F.array(p["g"], F.coalesce(p["w"], F.lit(""))))
    return F.filter(F.flatten(pairs), lambda x: x != "")


def verse_id(book: Column, chapter: Column, verse: Column) -> Column:
    return F.concat_ws(".", book, chapter.cast("string"), verse.cast("string"))


def book_prefix(verse: Column) -> Column:
    """Book of a verse id; '' without a dot."""
    return F.when(F.instr(verse, ".") > 0, F.substring_index(verse, ".", 1)).otherwise("")


def split_verse_id(verse: Column) -> list[Column]:
    """book, chapter, verse; missing or invalid numbers are 0, without a dot the book is the whole id."""
    parts = F.split(verse, r"\.")
    number = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("long"), F.lit(0))
    return [F.try_element_at(parts, F.lit(1)).alias("book"), number(2).alias("chapter"), number(3).alias("verse_no")]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def like_contains(c: Column, query: str) -> Column:
    """Substring search where only ASCII ignores case, % and _ in the query are wildcards, and a backslash is itself."""
    pattern = "%" + query.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\") + "%"
    return ascii_lower(c).like(pattern)


def in_book(verse: Column, book: str) -> Column:
    """Whether a verse id belongs to a book: its code and a dot, whatever the ASCII case."""
    return ascii_lower(verse).startswith(book.translate(str.maketrans(_UPPER, _LOWER)) + ".")


def strip_space(c: Column) -> Column:
    """Unicode white space cut at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def preview(c: Column, most: int = 140) -> Column:
    """White space collapsed, cut to `most` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most)), F.lit("…"))).otherwise(flat)


def sanitize_filename(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}._\- ]", "_"), r"^[. ]+|[. ]+$", "")


def stem_title(title: Column, filename: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.regexp_replace(filename, r"(?<=.)\.[^.]*$", ""))


def extension(filename: Column) -> Column:
    """Lower-cased extension after the last dot; '' without one."""
    return F.lower(F.regexp_extract(filename, r"\.([^.]*)$", 1))


def decode_confidence(c: Column) -> Column:
    """How far a decoded text can be trusted, by its share of replacement characters; 0 if empty."""
    bad = F.length(c) - F.length(F.replace(c, F.lit("�"), F.lit("")))
    return F.when(F.length(c) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - 10 * bad / F.length(c)))


def format_bytes(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.format_string("%.1f kB", n / 1024)).otherwise(F.format_string("%.1f MB", n / (1024 * 1024)))


def format_time(seconds: Column) -> Column:
    """[h:]mm:ss; a dash for null."""
    s = F.floor(seconds)
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(seconds.isNull(), "—").when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(r))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(r)))


def anchor_key(kind: Column, verse: Column, token: Column) -> Column:
    return F.when(kind == "word", F.concat(F.lit("w:"), verse, F.lit(":"), token.cast("string"))).otherwise(F.concat(F.lit("v:"), verse))


def normalize_reference(c: Column) -> Column:
    """A typed book name: ordinals as digits, lower case, without dots, apostrophes and spaces."""
    t = F.lower(strip_space(c))
    for pattern, digit in ORDINALS:
        t = F.regexp_replace(t, pattern, digit)
    return F.regexp_replace(F.regexp_replace(t, "[.’']", ""), r"(?U)\s+", "")


def alias(typed: Column) -> Column:
    """The code of the book that a typed alias stands for, null for anything else."""
    pairs = F.create_map(*[F.lit(x) for kv in sorted(ALIASES.items()) for x in kv])
    return pairs[normalize_reference(typed)]
