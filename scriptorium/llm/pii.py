"""Personal information in free text (problem 1): a skip-chain conditional random field.

Tokens near anything that could be personal (digits, at signs, names of the lexicon, titles, street words) form the field,
and with them every other token that is similar to a family name or a long number among them. Neighbours share transition
potentials, and similar tokens of a text share skip potentials however far apart they are: a family name that stands alone
after the full one, and a number whose kind is said only once, get their label from the distant place. Loopy max-product
message passing over all texts of a batch at once finds the labels. The weights were trained here, by pseudo-likelihood, on
sentences made by pii_train.py; the lexicon of names is made from all rows of the column of names.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import bitmap
from scriptorium.operators.tables import salted_join
from scriptorium.session import ready, spread

LABELS = ("O", "email", "phone", "id_number", "address", "name")
#: Rounds of message passing, and how much of the old message a new one keeps.
ROUNDS, DAMPING = 8, 0.2
#: Texts that are labelled at once.
SLICE = 1_000
#: Tokens around a candidate, and around a distant token that is similar to one, that belong to the field.
AROUND, AROUND_SIMILAR = 4, 2
#: Most words of a lexicon that is broadcast (some 100 MB in a worker); a larger one meets the words of the texts by a join.
LEXICON_WORDS = 1_000_000
#: Bits, as a power of two, of the bitmap by which words that may be names are chosen before that join: 32 MB.
WORD_BITS = 28
#: Letters of a word and digits of a number from which on similar ones share potentials.
LEAST_LETTERS, LEAST_DIGITS = 4, 4

#: Word lists.
TITLES = set("mr mrs ms miss mx dr rev reverend prof professor sister brother father mother elder pastor sir lady dame herr frau madame mme monsieur señor señora sr sra don doña deacon bishop rabbi canon".split())
SURE_TITLES = set("mr mrs ms miss mx dr rev prof herr frau mme señor señora".split())
GIVEN = set("anna anne james john mary peter paul thomas david michael robert william richard george henry edward charles joseph daniel matthew mark luke sarah rachel elizabeth margaret catherine susan julia laura emma sophia maria marie jean pierre louis claire hans karl fritz otto ursula heinrich carlos juan pedro luis jose carmen ana sofia ivan olga boris natasha ahmed fatima ali hassan mohammed ravi anita raj wei li ming yuki hiro".split())
NO_NAMES = set("choir chapel circle group voices voice speaker speakers panel council service services committee hymnal edition society band team class club fellowship youth evening morning guest host reading church house hall school road street lane unknown various several narrator reader".split())
STREETS = "road rd street st lane ln avenue ave close terrace way drive dr court ct square sq place pl row crescent gardens grove hill park boulevard blvd highway mews".split()
STREETS_BEFORE = "rue calle via rua avenida plaza place chemin allée impasse camino carrer ulitsa улица ул".split()
PHONE_WORDS = set("tel telephone phone call ring mob mobile cell number text fax whatsapp rückruf telefon téléphone appel teléfono llamar telefone ext dial handy unter".split())
ID_WORDS = set("ssn social security passport licence license dni national id tax ni nino identity identification personal insurance steuer ausweis reisepass pasaporte passeport cpf nif nie aadhaar pan".split())
TRAP_WORDS = set("isbn issn catalogue catalog shelf mark ms manuscript hymn hymns psalm verse verses chapter version grid map order copies attendance folio page pages fragments edition vol volume item sku outline".split())
ADDRESS_WORDS = set("lives live address visit post return meeting moves pick pick-up up at flat apt apartment suite wohnt adresse vive dirección unit box".split())
DIGIT_WORDS = "zero oh one two three four five six seven eight nine double triple".split()

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*(?:-[^\W\d_]+)*|\d+|[^\w\s]|_")
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*(?:-[^\W\d_]+)*")
_DIGITS = re.compile(r"\d(?:[ .\-/()\n]{0,3}\d){5,}|\d{2,}[ \-]?[A-Za-z]\b|\b[A-Za-z]{1,3}[ \-]?\d{5,}")
_LOCAL = r"[^\s@<>()\[\],;:\"]{1,64}"
_AT = r"(?:\s{0,2}@\s{0,2}|\s?[\[({]\s?(?:at|@)\s?[\])}]\s?|\s+at\s+)"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\s+dot\s+)"
_PART = r"[^\W_](?:[\w\-]{0,62}[^\W_])?"
_EMAIL = re.compile(rf"(?:mailto:)?(?P<local>[\w.+\-%]+(?:(?:\s?[\[(]dot[\])]\s?|\s+dot\s+)[\w.+\-%]+)*)(?P<at>{_AT})(?P<host>{_PART}(?:{_DOT}{_PART})*?(?P<dot>{_DOT}){_PART})(?![\w@])", re.I)
_EMAIL_HINT = re.compile(r"@|[\[({]\s?at\s?[\])}]|\sat\s(?=[^.!?]{1,60}\sdot\s)", re.I)
_DATE = re.compile(r"\b(?:\d{4}[\-/.]\d{1,2}[\-/.]\d{1,2}|\d{1,2}[\-/.]\d{1,2}[\-/.]\d{4})\b")
_ISBN = re.compile(r"\b97[89](?:[ \-]?\d){10}\b")
_REFERENCE = re.compile(r"\b\d{1,3}:\d{1,3}(?:\s?[\-–,]\s?\d{1,3})*\b|\b\d{1,2}\.\d{1,2}(?:\.\d{1,2})+\b")
_PHONES = {
    "intl": re.compile(r"(?<![\w+])(?:\+|00)\d{1,3}[ .\-]?(?:\(0\)[ .\-]?)?(?:\(?\d{1,5}\)?[ .\-]?){1,4}\d{2,6}(?![\w])"),
    "area": re.compile(r"(?<![\w+\-/.])(?:\(\d{3}\)\s?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?![\w]|[\-.]\d)"),
    "local": re.compile(r"(?<![\w+\-/.])\d{3}[\-. ]\d{4}(?:\s*(?:ext|x)\.?\s*\d{1,5})?(?![\w]|[\-.]\d)", re.I),
    "trunk": re.compile(r"(?<![\w+\-/.:])0\d{2,5}[ \-/.]\d{3,6}(?:[ \-.]\d{2,6}){0,3}(?![\w]|[\-.]\d)"),
    "plain": re.compile(r"(?<![\w+\-/.:])\d{10,11}(?![\w]|[\-.]\d)"),
    "spelled": re.compile(rf"\b(?:{'|'.join(DIGIT_WORDS)})(?:[\s,\-]+(?:{'|'.join(DIGIT_WORDS)})){{5,}}\b", re.I),
}
_IDS = {
    "ssn": re.compile(r"(?<![\w\-/.])\d{3}[ \-]\d{2}[ \-]\d{4}(?![\w]|[\-.]\d)"),
    "ni": re.compile(r"(?<![\w])[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d](?![\w])"),
    "letter": re.compile(r"(?<![\w])[A-Z]{1,2} ?\d{3} ?\d{4}(?![\w])|(?<![\w])[A-Z]\d{8}(?![\w])"),
    "slash": re.compile(r"(?<![\w\-/.])\d{2,3}/\d{3}/\d{4,5}(?![\w/])"),
    "dni": re.compile(r"(?<![\w\-/.])\d{8}-?[A-Za-z](?![\w])"),
    "licence": re.compile(r"(?<![\w])[A-Z]{2,3}-\d{3,4}-\d{4,6}(?![\w])"),
    "groups": re.compile(r"(?<![\w\-/.])\d{4}[\- ]\d{4}[\- ]\d{3,4}(?:[\- ]\d{4})?(?![\w]|[\-.]\d)"),
}
_CAPS = r"[\w’'.\-]+"
_ADDRESSES = {
    "street": re.compile(rf"(?:\b(?:flat|apt|apartment|unit|suite)\.?\s*\d+\s?[a-z]?,?\s+)?\b\d{{1,4}}\s?[a-z]?,?\s+(?:(?!(?:copies|verses|years|days)\b)[^\W\d_][\w’'.\-]*\s+){{1,3}}(?:{'|'.join(STREETS)})\b\.?", re.I),
    "before": re.compile(rf"\b(?:\d{{1,4}}\s?(?:bis|ter)?,?\s+)?(?:{'|'.join(STREETS_BEFORE)})\.?\s+(?:(?:de|la|le|les|du|des|del|da|do|los|las)\s+)*[^\W\d_][\w’'\-]*(?:\s+[^\W\d_][\w’'\-]*){{0,2}}(?:,?\s+\d{{1,4}}\s?[a-z]?\b|(?<=\s)(?<!\S))", re.I),
    "number_before": re.compile(rf"\b\d{{1,4}},?\s+(?:bis\s+|ter\s+)?(?:rue|avenue|boulevard|chemin|impasse|place|allée|via)\s+[^\W\d_][\w’'\-]*", re.I),
    "joined": re.compile(r"\b[^\W\d_][\w’'\-]*(?:weg|straße|strasse|str\.|gasse|platz|allee|straat|vej|gatan)\s+\d{1,4}\s?[a-z]?\b", re.I),
    "box": re.compile(r"\b(?:p\.?\s?o\.?\s*)?box\s+(?:no\.?\s*)?\d{1,6}\b|\b(?:postfach|apartado(?:\s+de\s+correos)?|caixa\s+postal|bo[iî]te\s+postale|b\.?\s?p\.)\s+\d{1,6}\b", re.I),
}
_TAIL = re.compile(r"(?:,\s*|\s+(?:in|at|à|en)\s+|\s+)?(?:(?:\d{4,5}|\d+º\s?[A-Z]|[A-Z]{1,2}\d{1,2}\s?\d[A-Z]{2}),?\s*)?(?:[A-ZÄÖÜÉ][\w’'\-]+(?:\s+[A-ZÄÖÜÉ][\w’'\-]+)?)?(?:,?\s+(?:[A-Z]{1,2}\d{1,2}\s?\d[A-Z]{2}|[A-Z]{2}\s\d{5}))?")
_PART_SPLIT = re.compile(r"\s*(?:[/;&|\n]|\band\b|\bund\b|\bet\b|\by\b)\s*")


# ---------------------------------------------------------------- lexicon


def name_pairs(value: str) -> list[tuple[str, str]]:
    """(given, family) pairs of a field that holds names, in lower case."""
    out = []
    for part in _PART_SPLIT.split(value):
        if "@" in part or any(c.isdigit() for c in part):
            continue
        if part.count(",") == 1:
            a, b = (x.strip() for x in part.split(","))
            part = f"{b} {a}" if a and b and " " not in a else part
        words = [w for w in _WORDS.findall(part) if w.lower() not in TITLES]
        if len(words) == 3 and len(words[1]) == 1:
            words = [words[0], words[2]]
        if len(words) == 2 and all(len(w) > 1 for w in words) and not any(w.lower() in NO_NAMES for w in words):
            out.append((words[0].lower(), words[1].lower()))
    return out


def fit_lexicon(values: list[str]) -> tuple[set[str], set[str]]:
    """Given and family names: words that combine freely with several of the other kind."""
    lasts: dict[str, set[str]] = {}
    firsts: dict[str, set[str]] = {}
    for v in values:
        for a, b in name_pairs(v):
            lasts.setdefault(a, set()).add(b)
            firsts.setdefault(b, set()).add(a)
    given = GIVEN | {a for a, bs in lasts.items() if len(bs) >= 2 and len(bs) >= len(firsts.get(a, ()))}
    family = {b for b, xs in firsts.items() if (len(xs) >= 2 or xs & given) and b not in given}
    given |= {a for a, bs in lasts.items() if bs & family and a not in family}
    return given, family


# ---------------------------------------------------------------- features


class Names:
    """The lexicon as the taggers use it."""

    def __init__(self, given: set[str], family: set[str]):
        self.given, self.family = frozenset(given), frozenset(family)
        self.all = self.given | self.family


def _kind_of(tok: str, names: Names) -> str:
    """Class of a token, one letter."""
    if tok[0].isdigit():
        return "d"
    if not tok[0].isalpha():
        return "," if tok == "," else "." if tok == "." else "p"
    low = tok.lower()
    if low in names.family:
        return "F"
    if low in names.given:
        return "G"
    if low in TITLES:
        return "T"
    if len(tok) == 1:
        return "I" if tok.isupper() else "l"
    if low in NO_NAMES:
        return "N"
    return "C" if tok[0].isupper() else "w"


#: Names as sequences of token classes: sure ones, and ones with a word that the lexicon lacks.
_NAME_SURE = re.compile(r"T\.?(?:G|I\.?){0,2}F|G(?:I\.?)?(?:G|I\.?)?F(?:F)?|I\.?(?:I\.?)?F|F,(?:T\.?)?(?:G|I)(?:I\.?)?|FG(?!F)|F,?I\.(?=$|[^F])")
_NAME_MAYBE = re.compile(r"T\.?G(?:I\.?)?C|G(?:I\.?)?C(?![w]{0}C{3})")


def _patterns(text: str) -> list[tuple[int, int, str]]:
    """(start, end, pattern) of everything that has the form of personal data or of what is taken for it."""
    out = []
    low = text.lower()
    if "@" in text or "at" in low and _EMAIL_HINT.search(text):
        for m in _EMAIL.finditer(text):
            word_at = "@" not in m["at"] and "[" not in m["at"] and "(" not in m["at"] and "{" not in m["at"]
            if word_at and "dot" not in m["dot"].lower():
                continue
            out.append((*m.span(), "email"))
    if any(c.isdigit() for c in text):
        numbers = _DIGITS.search(text) is not None
        if numbers:
            for name, rx in (("date", _DATE), ("isbn", _ISBN), ("reference", _REFERENCE)):
                out += [(*m.span(), name) for m in rx.finditer(text)]
            for name, rx in _PHONES.items():
                if name != "spelled":
                    out += [(*m.span(), f"phone.{name}") for m in rx.finditer(text)]
            for name, rx in _IDS.items():
                out += [(*m.span(), f"id.{name}") for m in rx.finditer(text)]
        for name, rx in _ADDRESSES.items():
            for m in rx.finditer(text):
                tail = _TAIL.match(text, m.end())
                out.append((m.start(), max(m.end(), tail.end() if tail else 0), f"address.{name}"))
    if any(f"{w} " in low for w in ("five", "one", "oh", "zero", "seven", "double")):
        out += [(*m.span(), "phone.spelled") for m in _PHONES["spelled"].finditer(text)]
    return out


_POSSESSIVE = re.compile(r"['’]s?$")
_DOUBLED = re.compile(r"(.)\1+")


@functools.lru_cache(100_000)
def similar(tok: str) -> str | None:
    """What similar tokens have in common: words without case, accents, doubled letters and possessive endings, numbers as
    they are; None for short tokens and signs."""
    if tok[0].isdigit():
        return tok if len(tok) >= LEAST_DIGITS else None
    if len(tok) < LEAST_LETTERS or not tok[0].isalpha():
        return None
    t = unicodedata.normalize("NFD", _POSSESSIVE.sub("", tok.casefold()))
    return _DOUBLED.sub(r"\1", "".join(c for c in t if not unicodedata.combining(c)))


_NAME_HINT = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Rev|Prof|MR|MRS|DR|REV|PROF|Herr|Frau)\b\.?\s+[^\W\d_]")


class Field:
    """The tokens of one text that take part, with their features."""

    __slots__ = ("tokens", "features", "breaks")

    def __init__(self, tokens, features, breaks):
        self.tokens, self.features, self.breaks = tokens, features, breaks


def field_of(text: str | None, names: Names) -> Field | None:
    """Tokens near candidates and their features; None if the text has no candidate."""
    if not text or text.isspace():
        return None
    found = _patterns(text)
    words = {w.lower() for w in _WORDS.findall(text)}
    named = not names.all.isdisjoint(words) or _NAME_HINT.search(text) is not None
    if not found and not named:
        return None
    toks = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text)]
    kinds = "".join(_kind_of(t, names) for t, _, _ in toks)
    kinds = re.sub(r"l(?=\.l?\.?F)|(?<=[FG],)l(?=\.)", "I", kinds)  # initials in lower case
    begins = {a: i for i, (_, a, _) in enumerate(toks)}
    flags: list[list[str]] = [[] for _ in toks]
    active = np.zeros(len(toks) + 1, bool)

    def mark(i: int, j: int, what: str) -> None:
        for k in range(i, j):
            flags[k].append(what)
        active[max(0, i - AROUND) : j + AROUND] = True

    starts = np.array([a for _, a, _ in toks] or [0])
    for a, b, what in found:
        i = begins.get(a)
        if i is None:
            i = int(np.searchsorted(starts, a))
        j = int(np.searchsorted(starts, b))
        mark(i, j, what)
    if named:
        for rx, what in ((_NAME_SURE, "name.sure"), (_NAME_MAYBE, "name.maybe")):
            for m in rx.finditer(kinds):
                i, j = m.span()
                if what == "name.maybe" and not _may_be_named(toks[i:j], kinds[i:j]):
                    continue
                if any("\n\n" in text[toks[k][2] : toks[k + 1][1]] for k in range(i, j - 1)):
                    continue
                mark(i, j, what)
        for m in _NAME_HINT.finditer(text):
            i = begins.get(m.start())
            if i is not None:
                k = i + 1 + (kinds[i + 1 : i + 2] == ".")
                if kinds[k : k + 1] == "C" and toks[i][0].lower() in SURE_TITLES:
                    mark(i, k + 1, "name.titled")
    if not active.any():
        return None
    shared = set()
    for (t, _, _), own, kind in zip(toks, flags, kinds, strict=True):
        if own and (kind in "FC" and any(x.startswith("name") for x in own) or kind == "d" and any(x.startswith(("phone", "id")) for x in own)):
            shared.add(similar(t))
    shared.discard(None)
    for i, (t, _, _) in enumerate(toks) if shared else ():
        if not active[i] and similar(t) in shared:
            active[max(0, i - AROUND_SIMILAR) : i + 1 + AROUND_SIMILAR] = True
    chosen = np.flatnonzero(active[: len(toks)])
    features, breaks = [], []
    last = -9
    for i in chosen.tolist():
        breaks.append(i != last + 1)
        last = i
        f = ["bias"]
        own = flags[i]
        context = _context(toks, i)
        for x in own or ("none",):
            f += [f"p={x}", f"p={x}|{kinds[i]}"]
            for c in context:
                f.append(f"p={x}&{c}")
        f.append(f"k={kinds[i]}")
        f.append(f"k-={kinds[i - 1] if i else '^'}{kinds[i]}")
        f.append(f"k+={kinds[i]}{kinds[i + 1] if i + 1 < len(kinds) else '$'}")
        if len(own) > 1:
            f.append("p=" + "+".join(sorted({x.split(".")[0] for x in own})))
        features.append(f)
    return Field([toks[i] for i in chosen], features, breaks)


def _may_be_named(toks: list[tuple[str, int, int]], kinds: str) -> bool:
    """A given name and a capital word: only if the given name has a capital too and nothing says otherwise."""
    return all(t[0].isupper() or not t[0].isalpha() for t, _, _ in toks) and toks[-1][0].lower() not in NO_NAMES


def _context(toks: list[tuple[str, int, int]], i: int) -> list[str]:
    """Kinds of key words among the six tokens before, nearest only."""
    for k in range(i - 1, max(-1, i - 7), -1):
        low = toks[k][0].lower()
        if low in TRAP_WORDS:
            return ["trap"]
        if low in ID_WORDS:
            return ["idword"]
        if low in PHONE_WORDS:
            return ["phoneword"]
        if low in ADDRESS_WORDS:
            return ["addressword"]
    return []


# ---------------------------------------------------------------- the field


class Model:
    """Weights: feature x label, chain potentials, and skip potentials of words and of numbers."""

    def __init__(self, features: dict[str, int], weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.features, self.weights, self.chain, self.skip = features, weights, chain, skip

    @classmethod
    def load(cls, path: str | None = None) -> Model:
        return _load(path or os.path.join(os.path.dirname(__file__), "models", "pii_crf.json"))

    def graph(self, fields: list[Field]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Emission scores of all tokens of all fields, chain edges, skip edges of words and of numbers.

        A token is joined to the similar one before it and to the first one with the form of personal data, so that what is
        said once reaches all others; edges grow linearly with the tokens.
        """
        rows, cols, n = [], [], 0
        chain, skips = [], ([], [])
        index = self.features
        for f in fields:
            seen: dict[str, int] = {}
            formed: dict[str, int] = {}
            for k, ((tok, _, _), fs) in enumerate(zip(f.tokens, f.features, strict=True)):
                for x in fs:
                    c = index.get(x)
                    if c is not None:
                        rows.append(n)
                        cols.append(c)
                if k and not f.breaks[k]:
                    chain.append((n - 1, n))
                if (key := similar(tok)) is not None:
                    before = {x for x in (seen.get(key), formed.get(key)) if x is not None and n - x > 1}
                    skips[tok[0].isdigit()].extend((x, n) for x in sorted(before))
                    seen[key] = n
                    if "p=none" not in fs:
                        formed.setdefault(key, n)
                n += 1
        scores = np.zeros((n, len(LABELS)))
        if rows:
            np.add.at(scores, np.array(rows), self.weights[np.array(cols)])
        return scores, *[np.array(x, np.int64).reshape(-1, 2) for x in (chain, *skips)]

    def labels(self, fields: list[Field]) -> list[np.ndarray]:
        """Labels of the tokens of each field by loopy max-product message passing."""
        scores, *kinds = self.graph(fields)
        if not len(scores):
            return [np.zeros(0, np.int64) for _ in fields]
        edges = np.concatenate(kinds)
        belief = scores
        if len(edges):
            u, v = edges[:, 0], edges[:, 1]
            pot = np.repeat(np.stack([self.chain, *self.skip]), [len(x) for x in kinds], axis=0)
            right, left = np.zeros((len(edges), len(LABELS))), np.zeros((len(edges), len(LABELS)))
            for _ in range(ROUNDS):
                belief = scores.copy()
                np.add.at(belief, v, right)
                np.add.at(belief, u, left)
                to_v = ((belief[u] - left)[:, :, None] + pot).max(axis=1)
                to_u = ((belief[v] - right)[:, None, :] + pot).max(axis=2)
                right = DAMPING * right + (1 - DAMPING) * (to_v - to_v.max(axis=1, keepdims=True))
                left = DAMPING * left + (1 - DAMPING) * (to_u - to_u.max(axis=1, keepdims=True))
            belief = scores.copy()
            np.add.at(belief, v, right)
            np.add.at(belief, u, left)
        best = belief.argmax(axis=1)
        cuts = np.cumsum([len(f.tokens) for f in fields])[:-1]
        return np.split(best, cuts)


@functools.lru_cache(2)
def _load(path: str) -> Model:
    with open(path, encoding="utf-8") as f:
        m = json.load(f)
    return Model({x: i for i, x in enumerate(m["features"])}, np.array(m["weights"]), np.array(m["chain"]), np.array(m["skip"]))


def spans_of(text: str, field: Field, labels: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each run of one label; signs at the edges are left out."""
    out: list[tuple[int, int, str]] = []
    run: list[int] = []

    def close() -> None:
        keep = list(run)
        while keep and not field.tokens[keep[-1]][0][0].isalnum() and field.tokens[keep[-1]][0] not in ")]":
            keep.pop()
        while keep and not field.tokens[keep[0]][0][0].isalnum() and field.tokens[keep[0]][0] not in "+(":
            keep.pop(0)
        if keep:
            out.append((field.tokens[keep[0]][1], field.tokens[keep[-1]][2], LABELS[labels[keep[0]]]))

    for i in range(len(field.tokens)):
        if run and (field.breaks[i] or labels[i] != labels[run[-1]]):
            close()
            run = []
        if labels[i]:
            run.append(i)
    if run:
        close()
    people = {similar(w) for a, b, kind in out if kind == "name" and len(ws := _WORDS.findall(text[a:b])) >= 2 for w in ws} - {None}
    return [s for s in out if _holds(text[s[0] : s[1]], s[2], people)]


def _holds(piece: str, kind: str, people: set[str]) -> bool:
    """The exact check after the field: a name has two parts or is part of one that has, numbers have digits, e-mail
    addresses their signs."""
    if kind == "name":
        words = _WORDS.findall(piece)
        return len(words) >= 2 or any(similar(w) in people for w in words)
    if kind in ("phone", "id_number"):
        return sum(c.isdigit() for c in piece) >= 6 or _PHONES["spelled"].search(piece) is not None
    if kind == "email":
        return "@" in piece or re.search(r"\bat\b", piece, re.I) is not None
    return any(c.isdigit() for c in piece)


def find_all(texts: list[str | None], names: Names, model: Model) -> list[list[tuple[int, int, str]]]:
    """Spans of personal data of each text."""
    fields = [field_of(t, names) for t in texts]
    some = [(i, f) for i, f in enumerate(fields) if f is not None and f.tokens]
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for (i, f), labels in zip(some, model.labels([f for _, f in some]), strict=True):
        out[i] = spans_of(texts[i], f, labels)
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by the placeholder of its kind, as in [EMAIL]."""
    parts, at = [], 0
    for a, b, kind in spans:
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(parts) + text[at:]


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame(sorted({p for v in batch["v"] for p in name_pairs(v)}), columns=["given", "family"])


def lexicon_table(values: DataFrame, column: str) -> DataFrame:
    """w, is_family: the lexicon by the rules of fit_lexicon, over all rows of a column that holds names.

    Distinct pairs are made and counted on the executors.
    """
    c = F.col
    named = values.where(c(column).isNotNull() & (F.trim(column) != "")).select(c(column).alias("v")).distinct()
    pairs = named.mapInPandas(_pairs, "given string, family string").distinct().checkpoint()
    lasts = pairs.groupBy(c("given").alias("w")).agg(F.count(F.lit(1)).alias("lasts"))
    firsts = pairs.groupBy(c("family").alias("w")).agg(F.count(F.lit(1)).alias("firsts"))
    words = lasts.join(firsts, "w", "full").fillna(0, ["lasts", "firsts"])
    words = words.withColumn("is_given", c("w").isin(*sorted(GIVEN)) | (c("lasts") >= 2) & (c("lasts") >= c("firsts")))
    with_given = pairs.join(words.where("is_given").select(c("w").alias("given")), "given", "left_semi").select(c("family").alias("w")).distinct().withColumn("meets_given", F.lit(True))
    words = words.join(with_given, "w", "left").withColumn("is_family", ~c("is_given") & ((c("firsts") >= 2) | F.coalesce("meets_given", F.lit(False)))).checkpoint()
    with_family = pairs.join(words.where("is_family").select(c("w").alias("family")), "family", "left_semi").select(c("given").alias("w")).distinct().withColumn("meets_family", F.lit(True))
    kinds = words.join(with_family, "w", "left").withColumn("is_given", c("is_given") | ~c("is_family") & F.coalesce("meets_family", F.lit(False)))
    return kinds.where("is_given or is_family").select("w", "is_family").checkpoint()


def _names(words: list) -> Names:
    return Names(GIVEN | {w for w, family in words if not family}, {w for w, family in words if family})


def lexicon_of(values: DataFrame, column: str) -> Names:
    """The lexicon, collected: for columns whose names one machine can hold."""
    return _names([tuple(r) for r in lexicon_table(values, column).collect()])


_FOUND = "tbl string, row_id string, kinds array<string>, redacted string"


def _found(part: pd.DataFrame, names: Names, model: Model) -> Iterator[tuple]:
    texts = part["text"].tolist()
    for tbl, row_id, text, spans in zip(part["tbl"], part["row_id"], texts, find_all(texts, names, model), strict=True):
        if spans:
            yield tbl, row_id, sorted({k for _, _, k in spans}), redact(text, spans)


def _by_broadcast(src: DataFrame, names: Names) -> DataFrame:
    shared = src.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model.load()
        for batch in batches:
            out = [x for at in range(0, len(batch), SLICE) for x in _found(batch.iloc[at : at + SLICE], shared.value, model)]
            if out:
                yield pd.DataFrame(out, columns=["tbl", "row_id", "kinds", "redacted"])

    return src.mapInPandas(run, _FOUND)


def _slots(words: list[str]) -> np.ndarray:
    hashes = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
    return bitmap.slots(hashes, WORD_BITS)


def _by_join(src: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The same where the lexicon is too large to broadcast: each text gets those of its words that are names."""
    c = F.col
    places = lexicon.mapInPandas(lambda it: (pd.DataFrame({"s": _slots(b["w"].tolist())}) for b in it), "s long")
    filled = src.sparkSession.sparkContext.broadcast(bitmap.build(places, "s", WORD_BITS))

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [sorted({w.lower() for w in _WORDS.findall(t)}) if t else [] for t in b["text"]]
            yield b.assign(words=[[w for w, x in zip(ws, bitmap.holds(filled.value, _slots(ws)), strict=True) if x] for ws in words])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model.load()
        for b in batches:
            names = _names([(x["w"], x["is_family"]) for own in b["names"] if own is not None for x in own])
            yield pd.DataFrame(list(_found(b, names, model)), columns=["tbl", "row_id", "kinds", "redacted"])

    marked = src.mapInPandas(mark, "tbl string, row_id string, text string, words array<string>").checkpoint().withColumn("at", F.monotonically_increasing_id())
    held = salted_join(marked.select("at", F.explode("words").alias("w")), lexicon, "w", ["at"])
    names = held.groupBy("at").agg(F.collect_list(F.struct("w", "is_family")).alias("names"))  # words of one text
    return marked.select("at", "tbl", "row_id", "text").join(names, "at", "left").mapInPandas(run, _FOUND)


def personal_fields(rows: DataFrame, names: Names | DataFrame) -> DataFrame:
    """tbl, row_id, kinds (array), redacted of every field with personal data; rows: tbl, row_id, text.

    Null, empty and blank texts have none. Texts are taken whole; a narrow pass, then each (tbl, row_id) once, however
    often it was delivered. A lexicon of more than LEXICON_WORDS words stays a table that is joined by word.
    """
    ready(rows.sparkSession)
    src = spread(rows.select("tbl", F.col("row_id").cast("string").alias("row_id"), "text"))  # as strings, large ids survive beside nulls
    if isinstance(names, Names):
        found = _by_broadcast(src, names)
    elif names.count() <= LEXICON_WORDS:
        found = _by_broadcast(src, _names([tuple(r) for r in names.collect()]))
    else:
        found = _by_join(src, names)
    found = found.dropDuplicates(["tbl", "row_id"])
    return found.select("tbl", F.col("row_id").cast(rows.schema["row_id"].dataType).alias("row_id"), "kinds", "redacted")
