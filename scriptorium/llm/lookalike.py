"""One consistent form for text that looks the same (problem 2).

Words of a language that hold nothing but its regular characters form its vocabulary, counted over the whole corpus. Every
suspicious word (look-alikes of other scripts, compatibility forms, combining sequences, invisible characters) walks the
vocabulary's trie with a weighted edit automaton: look-alikes and ignorables cost nothing, a letter of another script (or a
digit) that no table knows costs ODD in the place of a letter, any other edit EDIT. The cheapest, then most frequent word
within MAX_COST is its canonical spelling: up to two unknown letters are read from the vocabulary, while other words and
inflected forms are never changed into each other. Words without a canonical spelling are put right by table.

Words and vocabulary meet in partitions of language and first letters, as many letters as it takes until no partition holds
a large part of the vocabulary; words with unknown letters there meet it by their last letters, in a trie of words read
backwards. No vocabulary is broadcast or collected.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import ready, shuffle_partitions

#: Highest cost of a canonical spelling; cost of a letter that no table knows for a letter, and of any other edit.
MAX_COST, ODD, EDIT = 1.0, 0.5, 2.0
#: Letters of the keys under which words and vocabulary meet, tried in turn; then the whole signature is the key.
KEY_LETTERS = (2, 4, 8, 16)
#: A key is split if it has more than 1 / (KEY_PARTS * shuffle partitions) of the vocabulary, and at least KEY_WORDS words.
KEY_PARTS, KEY_WORDS = 4, 2_000

#: Letters that look like a Latin letter, from the public confusables data of Unicode.
LOOKALIKES = {
    "a": "аɑα", "c": "сϲⅽ", "d": "ԁⅾ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іıι", "j": "јϳ", "k": "κк", "l": "ӏⅼ", "m": "м", "n": "ոп", "o": "оοօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υսц", "v": "νѵ", "w": "ԝω", "x": "хχ", "y": "уγү",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "S": "ЅՏ", "T": "ТΤ", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "УΥҮ", "Z": "Ζ",
}
#: Pairs of the table that look alike only roughly: they count inside a word that has other letters of its language.
ROUGH = set("αικтτмкпгцυωγ")
#: Script of the languages.
SCRIPTS = {"en": "LATIN", "de": "LATIN", "fr": "LATIN", "es": "LATIN", "pt": "LATIN", "it": "LATIN", "nl": "LATIN", "la": "LATIN", "ru": "CYRILLIC", "uk": "CYRILLIC", "bg": "CYRILLIC", "el": "GREEK", "hi": "DEVANAGARI", "he": "HEBREW", "ar": "ARABIC", "zh": "CJK", "ja": "CJK"}
#: Codes for texts of an unknown language in a known script (private use); each has a vocabulary of its own.
UNKNOWN = {"LATIN": "qa", "CYRILLIC": "qb", "GREEK": "qc", "DEVANAGARI": "qd"}
SCRIPTS |= {code: name for name, code in UNKNOWN.items()}
#: Signs that look like a regular one.
SIGNS = {"‑": "-", "ʼ": "’", "ʹ": "’", "‛": "’", ";": ";", "ˈ": "'", "－": "-"}

PROTOTYPE = {c: latin for latin, others in LOOKALIKES.items() for c in others}
_IN_SCRIPT: dict[str, dict[str, str]] = {}
_WORD = re.compile(r"[^\s   -   　!-/:-@\[-`{-~¡«·»¿‐-‧‰-⁞、-〿।॥]+")
_NON_ASCII = r"[^\x00-\x7F]"


@functools.lru_cache(65536)
def script(c: str) -> str:
    """Script of a letter; '' for anything else."""
    if not c.isalpha():
        return ""
    name = unicodedata.name(c, "")
    first = name.split(" ")[0]
    return {"FULLWIDTH": "LATIN", "HALFWIDTH": "KATAKANA", "MATHEMATICAL": "LATIN", "HIRAGANA": "CJK", "KATAKANA": "CJK"}.get(first, first)


@functools.lru_cache(65536)
def ignorable(c: str) -> bool:
    """Characters that leave no visible trace."""
    return unicodedata.category(c) == "Cf" or c in "͏ᅟᅠ឴឵ㅤﾠ᠋᠌᠍᠎" or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef"


def needed_joiner(text: str, i: int) -> bool:
    """Whether a joiner stands where its script needs it: after a virama, or between Arabic letters."""
    if text[i] not in "‌‍" or i == 0:
        return False
    before, after = text[i - 1], text[i + 1 : i + 2]
    if unicodedata.combining(before) == 9:
        return True
    return script(before) in ("ARABIC", "SYRIAC") and bool(after) and script(after) in ("ARABIC", "SYRIAC")


@functools.lru_cache(65536)
def plain_form(c: str) -> str:
    """A compatibility letter or sign of another width or font as its plain form; else the character itself."""
    tag = unicodedata.decomposition(c).split(" ")[0]
    if tag in ("<wide>", "<narrow>", "<font>") or tag == "<compat>" and unicodedata.category(c) in ("Ll", "Lu", "Lo", "Lm", "Nl"):
        return unicodedata.normalize("NFKC", c)
    return SIGNS.get(c, c)


def in_script(c: str, home: str) -> str:
    """The letter of the home script that looks like c; c itself if there is none."""
    if home not in _IN_SCRIPT:
        table = {}
        for latin, others in LOOKALIKES.items():
            family = [latin, *others]
            own = [x for x in family if script(x) == home]
            if own:
                table |= {x: own[0] for x in family if script(x) != home}
        _IN_SCRIPT[home] = table
    return _IN_SCRIPT[home].get(c, c)


def home_of(language: str | None, text: str) -> str:
    """Script of the language; without one, the script of most letters."""
    if (s := SCRIPTS.get((language or "")[:2].lower())) is not None:
        return s
    counts: dict[str, int] = {}
    for c in text:
        if s := script(plain_form(c)[:1]):
            counts[s] = counts.get(s, 0) + 1
    return max(counts, key=lambda s: (counts[s], s == "LATIN")) if counts else "LATIN"


@functools.cache
def imitated() -> frozenset[str]:
    """Scripts whose letters plain Latin ones can stand for: there a text of ASCII only isn't regular as such."""
    return frozenset(script(c) for c in PROTOTYPE) - {"LATIN"}


@functools.lru_cache(200_000)
def judge(word: str, home: str) -> str:
    """`regular`, `doubtful` (a word of look-alikes only, of another script) or `irregular`."""
    if word.isascii() and home not in imitated():
        return "regular"
    if any(ignorable(c) and not needed_joiner(word, i) for i, c in enumerate(word)):
        return "irregular"
    if not unicodedata.is_normalized("NFC", word):
        return "irregular"
    if home != "CJK" and any(plain_form(c) != c for c in word):
        return "irregular"
    scripts = [(c, script(c)) for c in word]
    own = [c for c, s in scripts if s == home]
    foreign = [c for c, s in scripts if s and s != home]
    if not foreign:
        return "regular"
    alike = [c for c in foreign if in_script(c, home) != c]
    if own:
        return "irregular" if alike else "regular"
    if len({s for _, s in scripts if s}) > 1:
        return "irregular"
    return "doubtful" if len(alike) == len(foreign) and not all(c in ROUGH for c in alike) else "regular"


def table_form(text: str, home: str) -> str:
    """Regular characters by table: for words that no vocabulary knows and for what stands between words."""
    t = "".join(c for i, c in enumerate(text) if not ignorable(c) or needed_joiner(text, i))
    t = "".join(plain_form(c) for c in t) if home != "CJK" else t
    t = unicodedata.normalize("NFC", t)
    out = []
    for m in re.finditer(rf"({_WORD.pattern})|[\s\S]", t):
        w = m[0]
        if m[1] is None:
            out.append(" " if unicodedata.category(w) == "Zs" else w)
            continue
        scripts = {s for s in map(script, w) if s}
        if home in scripts and len(scripts) > 1:
            fits = all(script(c) in ("", home) or in_script(c, home) != c for c in unicodedata.normalize("NFD", w))
            target = home if fits else max(scripts - {home}, key=lambda s: sum(script(c) == s for c in w))
            w = unicodedata.normalize("NFC", "".join(in_script(c, target) for c in unicodedata.normalize("NFD", w)))
        out.append(w)
    return "".join(out)


def signature(word: str) -> str:
    """What words that look the same have in common: no ignorables, decomposed, each letter as its prototype."""
    t = "".join(plain_form(c) for c in word if not ignorable(c))
    return "".join(PROTOTYPE.get(c, c) for c in unicodedata.normalize("NFD", t))


def guessed_languages(words: DataFrame, group: str, column: str) -> DataFrame:
    """group, lang: the code of the script that most words of a group are in, for groups without a language."""
    letter = {"LATIN": "[A-Za-z\u00c0-\u024f]", "CYRILLIC": "[\u0400-\u04ff]", "GREEK": "[\u0370-\u03ff\u1f00-\u1fff]", "DEVANAGARI": "[\u0900-\u097f]"}
    counts = words.groupBy(group).agg(*[F.count_if(F.col(column).rlike(rx)).alias(name) for name, rx in letter.items()])
    most = F.greatest(*letter)
    lang = F.lit(None).cast("string")
    for name in reversed(letter):
        lang = F.when(F.col(name) == most, UNKNOWN[name]).otherwise(lang)
    return counts.select(group, F.when(most > 0, lang).alias("lang"))


def odd(c: str, home: str) -> bool:
    """Digits, and letters of other scripts that look like none of the home script by table."""
    return c.isdigit() or script(c) not in ("", home) and in_script(c, home) == c and PROTOTYPE.get(c, c) == c


def letters_of(word: str) -> str:
    """What the automaton reads: plain forms, decomposed, without ignorables."""
    return "".join(c for c in unicodedata.normalize("NFD", "".join(plain_form(x) for x in word)) if not ignorable(c))


def key_of(text: str, split: frozenset[str]) -> str:
    """The shortest beginning of a signature that isn't split further."""
    for n in KEY_LETTERS:
        if len(text) <= n or text[:n] not in split:
            return text[:n]
    return text


class Trie:
    """Vocabulary of decomposed words, read forwards or backwards; each end holds the most frequent spelling."""

    def __init__(self, home: str = "LATIN", back: bool = False):
        self.home, self.step = home, -1 if back else 1
        self.next: list[dict[str, int]] = [{}]
        self.word: list[tuple[int, str] | None] = [None]

    def add(self, word: str, n: int) -> None:
        at = 0
        for c in unicodedata.normalize("NFD", word)[:: self.step]:
            if ignorable(c):
                continue
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                self.next.append({})
                self.word.append(None)
            at = self.next[at][c]
        if self.word[at] is None or self.word[at] < (n, word):
            self.word[at] = (n, word)

    def canonical(self, word: str, most: float = MAX_COST) -> str | None:
        """Cheapest, then most frequent word of the vocabulary within the cost `most`."""
        states = {0: 0.0}
        self._skip(states, most)
        for c in letters_of(word)[:: self.step]:
            now: dict[int, float] = {}
            proto = PROTOTYPE.get(c, c)
            other = ODD if odd(c, self.home) else EDIT
            for at, cost in states.items():
                for x, to in self.next[at].items():
                    price = cost + (0.0 if x == c or PROTOTYPE.get(x, x) == proto else other if x.isalpha() else EDIT)
                    if price <= most and price < now.get(to, 9e9):
                        now[to] = price
                if cost + EDIT <= most and cost + EDIT < now.get(at, 9e9):
                    now[at] = cost + EDIT
            states = now
            self._skip(states, most)
            if not states:
                return None
        ends = [(cost, -self.word[at][0], self.word[at][1]) for at, cost in states.items() if self.word[at]]
        return min(ends)[2] if ends else None

    def _skip(self, states: dict[int, float], most: float) -> None:
        """Letters of the vocabulary that the word leaves out, at the cost of an edit each."""
        if most < EDIT:
            return
        queue = list(states)
        for at in queue:
            for to in self.next[at].values():
                if states[at] + EDIT <= most and states[at] + EDIT < states.get(to, 9e9):
                    states[to] = states[at] + EDIT
                    queue.append(to)


def suspicious(text: str, home: str) -> list[str]:
    return sorted({w for w in _WORD.findall(text) if judge(w, home) != "regular"})


def normal_form(text: str, home: str, canonical: dict[str, str]) -> str:
    """The text with canonical spellings for suspicious words, and by table what has none."""
    parts, at = [], 0
    for m in _WORD.finditer(text):
        w = m[0]
        kind = judge(w, home)
        if kind == "regular":
            continue
        parts.append(table_form(text[at : m.start()], home))
        parts.append(canonical.get(w) or (w if kind == "doubtful" else table_form(w, home)))
        at = m.end()
    parts.append(table_form(text[at:], home))
    return "".join(parts)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        homes = [home_of(lang, t) for lang, t in zip(batch["lang"], batch["text"], strict=True)]
        words = [suspicious(t, h) for t, h in zip(batch["text"], homes, strict=True)]
        out = batch.assign(home=homes, words=words)
        changed = [bool(w) or table_form(t, h) != t for w, t, h in zip(words, batch["text"], homes, strict=True)]
        yield out[changed]


def _vocabulary_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        parts = batch.assign(word=[_WORD.findall(w) for w in batch["word"]]).explode("word").dropna(subset=["word"])
        good = parts[[judge(w, h) == "regular" for w, h in zip(parts["word"], parts["home"], strict=True)]]
        yield good.assign(sig=[signature(w) for w in good["word"]])


_MET = "home string, lang string, back boolean, key string, word string, n long"


def _asked(word: str, home: str, split: frozenset[str]) -> tuple[bool, str] | None:
    """Where a word meets the vocabulary: by its first letters, by its last, or nowhere if both hold unknown letters."""
    sig = signature(word)
    for back in (False, True):
        text = sig[::-1] if back else sig
        key = key_of(text, split)
        if not any(odd(c, home) for c in key):
            return back, key
    return None


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of (home, lang, back, key, n): vocabulary first, then the words to look up."""
    at, trie = None, Trie()
    for batch in batches:
        out = []
        for home, lang, back, key, word, n in zip(*[batch[x.split()[0]] for x in _MET.split(", ")], strict=True):
            if (home, lang, back, key) != at:
                at, trie = (home, lang, back, key), Trie(home, back)
            if n > 0:
                trie.add(word, n)
            elif (found := trie.canonical(word, MAX_COST if judge(word, home) == "irregular" else 0.0)) is not None and found != word:
                out.append((home, lang, word, found))
        yield pd.DataFrame(out, columns=["home", "lang", "word", "canonical"])


def _split_keys(vocabulary: DataFrame, parts: int) -> frozenset[str]:
    """Beginnings of signatures, forwards and backwards, that hold too much of the vocabulary: at most KEY_PARTS * parts of each length."""
    starts = F.array(*[F.left(x, F.lit(n)) for x in (F.col("sig"), F.reverse("sig")) for n in KEY_LETTERS])
    counts = vocabulary.select("home", "lang", F.explode(F.array_distinct(starts)).alias("key")).groupBy("home", "lang", "key").agg(F.count(F.lit(1)).alias("n"))
    least = max(KEY_WORDS, vocabulary.count() // (KEY_PARTS * parts))
    return frozenset(r["key"] for r in counts.where(f"n > {least}").select("key").distinct().collect())


def normalized(rows: DataFrame, words: DataFrame) -> DataFrame:
    """tbl, row_key, text, normal of every row whose text changes; each row_key once.

    rows: tbl, row_key, lang, text. words: lang, word, the occurrences that make up the vocabulary. Null and empty texts
    never change; plain ASCII is regular unless Latin letters look like those of the language's script. An unknown language is judged by the text's own script.
    Repeated rows count once. Texts are taken whole.
    """
    parts = shuffle_partitions(ready(rows.sparkSession))
    c = F.col
    script_of = F.create_map(*[F.lit(x) for kv in SCRIPTS.items() for x in kv])
    own = script_of[F.lower(F.substring("lang", 1, 2))]
    src = rows.where(c("text").rlike(_NON_ASCII) | own.isin(*imitated()) & (c("text") != "")).select("tbl", "row_key", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    scanned = src.mapInPandas(_scan, "tbl string, row_key string, lang string, text string, home string, words array<string>").dropDuplicates(["tbl", "row_key"]).checkpoint()
    counts = words.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "word").agg(F.count(F.lit(1)).alias("n"))
    home = F.coalesce(own, F.lit("LATIN"))
    vocabulary = counts.withColumn("home", home).mapInPandas(_vocabulary_words, "lang string, word string, n long, home string, sig string").checkpoint()
    split = rows.sparkSession.sparkContext.broadcast(_split_keys(vocabulary, parts))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = [(h, lang, *m, w, -1) for h, lang, w in zip(b["home"], b["lang"], b["word"], strict=True) if (m := _asked(w, h, split.value)) is not None]
            yield pd.DataFrame(at, columns=["home", "lang", "back", "key", "word", "n"])

    def offer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for back in (False, True):
                keys = [key_of(x[::-1] if back else x, split.value) for x in b["sig"]]
                yield b.assign(back=back, key=keys)[["home", "lang", "back", "key", "word", "n"]]

    asked = scanned.select("home", "lang", F.explode("words").alias("word")).distinct().mapInPandas(ask, _MET).checkpoint()
    wanted = asked.select("home", "lang", "back", "key").distinct()
    offered = vocabulary.mapInPandas(offer, _MET).join(wanted, ["home", "lang", "back", "key"], "left_semi")  # only what someone asks for
    both = offered.select(*asked.columns).unionByName(asked).repartition(parts, "home", "lang", "back", "key").sortWithinPartitions("home", "lang", "back", "key", c("n").desc())
    spelled = both.mapInPandas(_walk, "home string, lang string, word string, canonical string")
    pairs = scanned.select("tbl", "row_key", "home", "lang", F.explode("words").alias("word")).join(spelled, ["home", "lang", "word"]).groupBy("tbl", "row_key").agg(F.collect_list(F.struct("word", "canonical")).alias("spelled"))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            normal = []
            for t, h, s in zip(b["text"], b["home"], b["spelled"], strict=True):
                normal.append(normal_form(t, h, {} if s is None else {x["word"]: x["canonical"] for x in s}))
            yield b[["tbl", "row_key", "text"]].assign(normal=normal)

    out = scanned.select("tbl", "row_key", "home", "text").join(pairs, ["tbl", "row_key"], "left").mapInPandas(apply, "tbl string, row_key string, text string, normal string")
    return out.where("text <> normal")
