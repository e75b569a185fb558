"""Text that was decoded with the wrong character encoding (problem 3).

For every pair of a right and a wrong encoding the garbled form of every character of the usual scripts is computed
beforehand, once and twice over, also as numeric character references. One multi-pattern automaton holds them all; only
matched spans are replaced, so correct text around them stays as it is. Where right and wrong encoding both have one byte
per character, a garbled word is known by letters that no script mixes (bigrams in the same automaton), and is turned back
as a word. Encodings of two bytes a character are tried on whole runs, in both directions: their text read as a Western one,
which must come back with the most frequent characters of its language, and UTF-8 read as one of them, which must come back
as valid UTF-8. A run that is garbled but can't be told is left as it is and counted as lost.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import spread

#: Encodings that UTF-8 is taken for, and those that it is taken for twice.
WRONG = ("latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "mac_roman", "koi8-r", "cp866", "iso8859-15")
TWICE = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251")
#: Scripts with two or three bytes a character, and the blocks of ideographs with the encodings they are tried with.
REPERTOIRE = ((0xA0, 0x180), (0x218, 0x21C), (0x386, 0x3CF), (0x400, 0x460), (0x490, 0x492), (0x591, 0x5C8), (0x5D0, 0x5EB), (0x620, 0x653), (0x901, 0x970), (0x1EA0, 0x1EFA), (0x1F00, 0x2000), (0x200B, 0x2010), (0x2010, 0x2028), (0x2030, 0x203B), (0x20AC, 0x20AD), (0x2122, 0x2123), (0x2190, 0x2194), (0x2212, 0x2213), (0x221E, 0x221F), (0x2248, 0x2249), (0x2260, 0x2266), (0xFEFF, 0xFF00))
WIDE = ((0x3000, 0x3100), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0xFF00, 0xFF5F))
WIDE_WRONG = ("latin-1", "cp1252", "cp437", "cp850", "mac_roman", "cp1251")
#: One-byte encodings of scripts that are read as a Latin one, and as each other.
ONE_BYTE = ("cp1251", "cp1253", "koi8-r", "cp866", "iso8859-5", "iso8859-7", "cp1255", "cp1256")
#: Encodings of two bytes a character that are read as a Western one, and that UTF-8 is read as.
TWO_BYTE = ("gbk", "big5", "cp932", "euc_jp", "cp949")
#: Characters of a run of two-byte text, and shares of frequent ones by which its encoding is told.
LEAST_RUN = 4
TOLD_SHARE = {"gbk": 0.12, "big5": 0.12, "cp932": 0.3, "euc_jp": 0.3, "cp949": 0.2}

#: Most frequent characters, by language, as published for general text.
FREQUENT = {
    "gbk": set("的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里如他她，。、“”：；！？"),
    "big5": set("的一是不了在人有我他這個們中來上大為和國地到以說時要就出會可也你對生能而子那得於著下自之年過發後作裡如她，。、「」：；！？"),
    "cp932": set("あいうえおかがきくけこさしすせそただちってでとどなにのはばまみめもやよらりるれろわをんアイウカクコシスタットドナニラリルレロンー、。「」"),
    "euc_jp": set("あいうえおかがきくけこさしすせそただちってでとどなにのはばまみめもやよらりるれろわをんアイウカクコシスタットドナニラリルレロンー、。「」"),
    "cp949": set("이다는을의에가고하지로기한사은도리자를나어시들대서인그아라것있해수정제와게만부일여주보과니스장적"),
}
#: Most frequent letters of the scripts of one-byte encodings.
FREQUENT_LETTERS = set("оеаинтсрαοιετσνηילוהמאתראليمنتورבة")

#: Russian letters by frequency in per cent, as published for general text.
RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (10.97, 8.45, 8.01, 7.35, 6.70, 6.26, 5.47, 4.73, 4.54, 4.40, 3.49, 3.21, 2.98, 2.81, 2.62, 2.01, 1.90, 1.74, 1.70, 1.65, 1.59, 1.44, 1.21, 0.97, 0.94, 0.73, 0.64, 0.48, 0.36, 0.32, 0.26, 0.04, 0.04), strict=True))
#: Vowels of the scripts that one-byte encodings garble.
VOWELS = set("аеёиоуыэюяіїєαεηιουωάέήίόύώϊϋΐΰ")

_HIGH_WORD = re.compile(r"[À-ÿŒœŠšŽžŸ]+")
_CYRILLIC_WORD = re.compile(r"[А-яЁё]+")
_WESTERN_HIGH = "\\x80-\\xff\u20ac\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\u017d\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\u017e\u0178"
#: Pairs of a high byte and any that can follow one, as Western characters; with single kana and signs between them.
_TWO_BYTE_RUN = re.compile(rf"(?:[{_WESTERN_HIGH}][{_WESTERN_HIGH}@-~]?)+")
_EASTERN_RUN = re.compile("[\u0370-\u03ff\u0400-\u04ff\u2010-\u2027\u2460-\u26ff\u3000-\u9fff\uac00-\ud7a3\uf900-\ufaff\uff01-\uffee\ue000-\uf8ff\u20ac]+")
#: Small letters of Western languages, and what they become as DOS or Mac text that a Latin word can't hold after its first letter.
_ACCENTED = set("àáâãäåçèéêëìíîïñòóôõöøùúûüý")
_WESTERN_ODD = frozenset(x for c in _ACCENTED for e in ("cp850", "cp437", "mac_roman") if not (x := c.encode("cp1252").decode(e)).islower() or "Ͱ" <= x <= "Ͽ") - set("-'’.,;:·–—‘“”„‚\xa0˚˙¸¨ˇ˜¯§¶†‡°´²³¹¾")
_WESTERN_WORD = re.compile(rf"(?<![^\W\d_])[A-Za-zÀ-ÿ](?:[^\W\d_]|[{re.escape(''.join(sorted(c for c in _WESTERN_ODD if not c.isalpha())))}](?=[^\W\d_]))+(?![^\W\d_])")
_CLOSING, _OPENING = set("”’»›"), set("“‘«‹„‚")


def read_as(data: bytes, wrong: str) -> str:
    """Bytes in the wrong encoding; a byte that it does not have stands for itself, as in most decoders on the web."""
    try:
        return data.decode(wrong)
    except UnicodeDecodeError:
        out = []
        for b in data:
            try:
                out.append(bytes([b]).decode(wrong))
            except UnicodeDecodeError:
                out.append(chr(b))
        return "".join(out)


#: How much a form by itself says: correct text can hold WEAK ones now and then and SOFT ones anywhere.
SOFT, WEAK, STRONG = 0, 1, 2


def _weight(garbled: str, wrong: str, char: str) -> int:
    """SOFT: letters that stand together in correct words. WEAK: forms that correct text can hold by chance."""
    if wrong not in ("cp1252", "latin-1", "iso8859-15") or garbled[0] not in "ÃÂâÐÑÎÏàäåæçèéãáÅÄ":
        if all("А" <= c <= "я" or c in "Ёё" for c in garbled) or all("Ά" <= c <= "ώ" for c in garbled) or (len(garbled) == 2 or char.isalpha()) and all(c.isalpha() and c <= "ɏ" for c in garbled):
            return SOFT
    if wrong == "cp1251" and len(garbled) == 2 or wrong == "mac_roman" and garbled[0] in "–—":
        return WEAK
    if wrong in ("cp1253", "cp1250", "cp1254") and garbled[-1] in "”’»…–—":
        return WEAK
    return STRONG


@functools.lru_cache(1)
def patterns() -> dict[str, list[tuple[str, str, int]]]:
    """Garbled form -> [(character, wrong encoding, weight)], a form can come from several pairs."""
    out: dict[str, list[tuple[str, str, int]]] = {}
    narrow = [chr(c) for a, b in REPERTOIRE for c in range(a, b) if unicodedata.category(chr(c)) != "Cn"]
    wide = [chr(c) for a, b in WIDE for c in range(a, b)]
    for chars, wrongs in ((narrow, WRONG), (wide, WIDE_WRONG)):
        for wrong in wrongs:
            for c in chars:
                g = read_as(c.encode(), wrong)
                out.setdefault(g, []).append((c, wrong, _weight(g, wrong, c)))
                if wrong in TWICE:
                    for again in ("cp1252", "latin-1") if wrong in ("cp1252", "latin-1") else (wrong,):
                        out.setdefault(read_as(g.encode("utf-8", "surrogatepass"), again), []).append((c, f"{wrong}, {again}", STRONG))
                if wrong in ("latin-1", "cp1252"):
                    out.setdefault("".join(f"&#{ord(x)};" for x in g), []).append((c, "reference", STRONG))
    for b in range(0x80, 0xA0):  # cp1252 read as Latin-1
        out[chr(b)] = [(read_as(bytes([b]), "cp1252"), "c1", STRONG)]
    out["\ufffd"] = [("\ufffd", "lost", STRONG)]
    return out


@functools.lru_cache(1)
def _four_bytes() -> tuple[re.Pattern, list[tuple[str, dict[str, int]]], frozenset[str]]:
    """Characters above U+FFFF are too many for a table: a pattern of all their forms, the byte of each part of a form by
    encoding, and what forms begin with."""
    units = []
    for wrong in WRONG:
        byte = [read_as(bytes([b]), wrong) for b in range(256)]
        units.append((wrong, {byte[b]: b for b in range(0x80, 0x100)}))
        if wrong in TWICE:
            for again in ("cp1252", "latin-1") if wrong in ("cp1252", "latin-1") else (wrong,):
                units.append((f"{wrong}, {again}", {read_as(byte[b].encode(), again): b for b in range(0x80, 0x100)}))
    units.append(("reference", {f"&#{b};": b for b in range(0x80, 0x100)} | {f"&#{ord(read_as(bytes([b]), 'cp1252'))};": b for b in range(0x80, 0x100)}))

    def either(of: dict[str, int], low: int, high: int) -> str:
        return "(?:" + "|".join(re.escape(u) for u, b in of.items() if low <= b < high) + ")"

    forms = [f"{either(of, 0xF0, 0xF5)}{either(of, 0x80, 0xC0)}{{3}}" for _, of in units]
    begins = frozenset(u[0] for _, of in units for u, b in of.items() if 0xF0 <= b < 0xF5)
    return re.compile("|".join(f"({x})" for x in forms)), units, begins


def _four_byte_spans(text: str) -> list[tuple[int, int, list]]:
    """(start, end, [(character, wrong encoding, weight)]) of each garbled character above U+FFFF."""
    rx, units, begins = _four_bytes()
    if begins.isdisjoint(text):
        return []
    out = []
    for m in rx.finditer(text):
        wrong, of = units[m.lastindex - 1]
        parts, at = [], 0
        while at < len(m[0]):
            size = next(k for k in range(len(m[0]) - at, 0, -1) if m[0][at : at + k] in of)
            parts.append(of[m[0][at : at + size]])
            at += size
        try:
            char = bytes(parts).decode()
        except UnicodeDecodeError:
            continue
        if unicodedata.category(char) not in ("Cn", "Cc", "Co"):
            out.append((*m.span(), [(char, wrong, STRONG)]))
    return out


@functools.lru_cache(1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for g, pairs in patterns().items():
        a.add_word(g, (len(g), pairs))
    latin = "abcdefghijklmnopqrstuvwxyz"
    for x in latin + latin.upper():  # letters that stand side by side in no script: one-byte encodings
        for y in [chr(c) for c in (*range(0x410, 0x450), 0x401, 0x451, 0x404, 0x454, 0x406, 0x456, 0x407, 0x457)]:
            for pair in (x + y, y + x):
                if pair not in a:
                    a.add_word(pair, (2, None))
    a.make_automaton()
    return a


def _plausible(word: str) -> bool:
    """Whether a word of a one-byte script looks like one: case, vowels, no long clusters; final forms at the end."""
    if all("\u05d0" <= c <= "\u05ea" for c in word):
        return not any(c in "ךםןףץ" for c in word[:-1]) and not word[-1:] in "כמנצ"
    if all("\u0621" <= c <= "\u064a" for c in word):
        return not any(c in "ةى" for c in word[:-1])
    low = word.lower()
    if not word.isalpha() or not (word == low or word[1:] == low[1:] or word.isupper() and len(word) < 3):
        return False
    if any(not ("Ͱ" <= c <= "ӿ") for c in word):
        return False
    vowels = [c in VOWELS for c in low]
    cluster = most = 0
    for v in vowels:
        cluster = 0 if v else cluster + 1
        most = max(most, cluster)
    return 0.2 <= sum(vowels) / len(low) <= 0.8 and most <= 4


def _as_bytes(run: str) -> bytes | None:
    """A run of Western characters as the bytes it was read from; cp1252 first, then Latin-1 for what that lacks."""
    out = bytearray()
    for c in run:
        try:
            out += c.encode("cp1252")
        except UnicodeEncodeError:
            if ord(c) > 0xFF:
                return None
            out.append(ord(c))
    return bytes(out)


def _utf8_share(data: bytes) -> float:
    """How much of the high bytes is valid UTF-8."""
    high = sum(b >= 0x80 for b in data)
    return sum(len(c.encode()) for c in data.decode("utf-8", "ignore") if c > "\x7f") / max(1, high)


def _two_byte_spans(text: str) -> list[tuple[int, int, str, bool]]:
    """Runs of two-byte text read as cp1252 or Latin-1. One encoding is taken for all runs of a text."""
    runs, score = [], {}
    for m in _TWO_BYTE_RUN.finditer(text):
        a, b = m.span()
        if b - a < LEAST_RUN or not (text[a - 1 : a] + text[b : b + 1]).isascii():
            continue
        data = _as_bytes(m[0])
        if data is None or sum(x >= 0x80 for x in data) < LEAST_RUN or _utf8_share(data) > 0.5:
            continue
        fits = {}
        for enc in TWO_BYTE:
            for cut in (0, 1):  # the last letter may belong to what follows
                try:
                    back = data[: len(data) - cut].decode(enc)
                except UnicodeDecodeError:
                    continue
                fits[enc] = (back, b - cut)
                wide = [c for c in back if c > "\x7f"]
                hits, all_ = score.get(enc, (0, 0))
                score[enc] = hits + sum(c in FREQUENT[enc] for c in wide), all_ + len(wide)
                break
        if fits:
            runs.append((a, b, fits))
    if not runs:
        return []
    best = max(score, key=lambda e: (score[e][0] / max(1, score[e][1]) * (1 if score[e][1] * 2 >= max(n for _, n in score.values()) else 0.5), -TWO_BYTE.index(e)))
    hits, n = score[best]
    if hits >= 2 and n >= LEAST_RUN and hits / n >= TOLD_SHARE[best]:
        return [(a, fits[best][1], fits[best][0], True) if best in fits else (a, b, text[a:b], False) for a, b, fits in runs]
    return []


def _eastern_spans(text: str) -> list[tuple[int, int, str, bool]]:
    """Runs of UTF-8 text read as a two-byte encoding: turned back they are valid UTF-8, but for bytes lost at their ends."""
    out = []
    for m in _EASTERN_RUN.finditer(text):
        a, b = m.span()
        if sum(c >= "\u2e80" for c in m[0]) * 2 < b - a:
            continue
        for enc in TWO_BYTE:
            try:
                data = m[0].encode(enc)
            except UnicodeEncodeError:
                continue
            if len(data) < 6 and not (_latin(text[a - 1 : a]) or _latin(text[b : b + 1])):
                continue
            for head, tail in ((0, 0), (0, 1), (1, 0), (0, 2), (1, 1)):
                try:
                    back = data[head : len(data) - tail].decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if len(data) < 6:  # one or two letters inside a Latin word
                    if head + tail == 0 and all("À" <= c <= "ɏ" for c in back):
                        out.append((a, b, back, True))
                elif sum(c > "\x7f" for c in back) >= 2 and all(unicodedata.category(c)[0] in "LMNPSZ" for c in back):
                    out.append((a, b, back, head + tail == 0))
                break
            else:
                continue
            break
    return out


def _turn_back(word: str, wrong: str, right: str) -> str | None:
    try:
        return word.encode(wrong).decode(right)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None


def _one_byte_words(text: str) -> list[tuple[int, int, str]]:
    """Words of another script read as Latin, or of KOI8-R read as Windows Cyrillic: (start, end, restored)."""
    out, short, votes = [], [], {}
    if any("À" <= c <= "ÿ" for c in text):
        for m in _HIGH_WORD.finditer(text):
            a, b = m.span()
            if text[a - 1 : a].isalpha() or text[b : b + 1].isalpha():
                continue
            w = m[0]
            fits = {right: back for right in ONE_BYTE if (back := _turn_back(w, "cp1252", right) or _turn_back(w, "latin-1", right)) and _plausible(back)}
            if len(w) >= 3 and fits:
                for right, back in fits.items():
                    votes[right] = votes.get(right, 0) + sum(c in FREQUENT_LETTERS for c in back.lower())
                out.append((a, b, w, fits))
            elif len(w) < 3:
                short.append((a, b, w))
    spans = []
    if out:
        best = max(votes, key=lambda r: (votes[r], -ONE_BYTE.index(r)))
        spans = [(a, b, fits.get(best) or next(iter(fits.values()))) for a, b, _, fits in out]
        edges = {a for a, _, _ in spans} | {b for _, b, _ in spans}
        for a, b, w in short:  # short words only beside longer ones
            near = any(x in edges for x in (b + 1, b + 2, a - 1, a - 2))
            if near and (back := _turn_back(w, "cp1252", best)):
                spans.append((a, b, back))
                edges |= {a, b}
    if any("А" <= c <= "Я" for c in text):
        best, most = [], 0.25
        for wrong, right in (("cp1251", "koi8-r"), ("koi8-r", "cp1251")):
            mixed, letters, gain = [], 0, 0.0
            for m in _CYRILLIC_WORD.finditer(text):
                w = m[0]
                if _latin(text[m.start() - 1 : m.start()]) or _latin(text[m.end() : m.end() + 1]):
                    continue
                back = _turn_back(w, wrong, right)
                upper = sum(c.isupper() for c in w)
                if back is None or upper * 2 < len(w) and not (len(w) < 3 and upper):
                    continue
                mixed.append((*m.span(), back))
                letters += len(w)
                gain += sum(_log(b) - _log(c) for b, c in zip(back.lower(), w.lower(), strict=True))
            if letters >= 5 and gain / letters > most:
                best, most = mixed, gain / letters
        spans += best
    return spans + _western_words(text)


def _western_words(text: str) -> list[tuple[int, int, str]]:
    """Western words in cp1252 read as a DOS or Mac encoding: capitals, Greek letters or signs after small Latin letters."""
    if text.isascii():
        return []
    found, votes = [], dict.fromkeys(("cp850", "cp437", "mac_roman"), 0)
    for m in _WESTERN_WORD.finditer(text):
        w = m[0]
        if _WESTERN_ODD.isdisjoint(w[1:]) or sum("a" <= c <= "z" for c in w) < 3 or any("A" <= c <= "Z" for c in w[1:]):
            continue
        fits = {}
        for wrong in votes:
            back = "".join(c if c.isascii() else _turn_back(c, wrong, "cp1252") or c for c in w)
            letters = [c for c in back if not c.isascii()]
            if all(c in _ACCENTED or c == "ß" for c in letters):
                fits[wrong] = back
                votes[wrong] += sum(3 if c in "éèàáíóúñçäöüß" else 1 for c in letters)
        if fits:
            found.append((*m.span(), fits))
    return [(a, b, fits[max(fits, key=lambda e: votes[e])]) for a, b, fits in found]


def _log(c: str) -> float:
    import math

    return math.log(RUSSIAN.get(c, 0.02))


def garbled_spans(text: str | None) -> list[tuple[int, int, str, bool]]:
    """(start, end, restored text, whether it could be restored) of each garbled place, in order, without overlap."""
    if not text or text.isascii() and "&#" not in text:
        return []
    found, words, votes = [], set(), {}
    wide = _two_byte_spans(text) + _eastern_spans(text)
    if wide:  # the bytes of two-byte text form characters of other encodings by chance
        whole, parts, at = text, [], 0
        for a, b, *_ in sorted(wide):
            parts += [text[at:a], " " * (b - a)]
            at = max(at, b)
        text = "".join(parts) + whole[at:]
    for end, (n, pairs) in automaton().iter_long(text):
        a, b = end - n + 1, end + 1
        if pairs is None:  # a word that mixes scripts
            while a > 0 and text[a - 1].isalpha():
                a -= 1
            while b < len(text) and text[b].isalpha():
                b += 1
            words.add((a, b))
            continue
        for _, wrong, weight in pairs:
            votes[wrong] = votes.get(wrong, 0) + 1 + weight
        found.append((a, b, pairs))
    if high := _four_byte_spans(text):
        for *_, pairs in high:
            votes[pairs[0][1]] = votes.get(pairs[0][1], 0) + 1 + STRONG
        found = sorted([f for f in found if not any(f[0] < b and a < f[1] for a, b, _ in high)] + high, key=lambda f: f[:2])
    runs: list[list[tuple[int, int, list]]] = []
    for f in found:
        if runs and runs[-1][-1][1] == f[0]:
            runs[-1].append(f)
        else:
            runs.append([f])
    out: list[tuple[int, int, str, bool]] = list(wide)
    doubtful, sure = [], {}
    for run in runs:
        weights = [max(w for _, _, w in pairs) for _, _, pairs in run]
        a, b = run[0][0], run[-1][1]
        before, after = text[a - 1 : a], text[b : b + 1]
        strong, weak = weights.count(STRONG), weights.count(WEAK)
        if not strong and weak < 2 and not (weak and text[a] in "ВГ" and (_latin(before) or _latin(after)) and text[b - 1] != "\xa0"):
            doubtful.append(run)
            continue
        if len(run) == 1 and b - a == 2 and not after.isalpha() and text[a].isalpha():  # an accented capital before a sign
            last = text[b - 1]
            if last in _CLOSING and (before in _OPENING or _open_quote(text, a)):
                continue
            if before.isupper() and last in "\u2026\u2013\u2014\u201c\u201d\u2018\u2019\u2020\u2021\u2022\xa0":
                continue
        for x, y, pairs in run:
            char, wrong, _ = max(pairs, key=lambda p: votes[p[1]])
            sure[wrong] = sure.get(wrong, 0) + 1
            out.append((x, y, char, char != "\ufffd"))
    for run in doubtful:  # letters that the encoding found elsewhere in the text explains, but no plain Cyrillic or Greek
        for x, y, pairs in run:
            char, wrong, _ = max(pairs, key=lambda p: sure.get(p[1], 0))
            if sure.get(wrong, 0) >= 3 and not "Ͱ" <= text[x] <= "ӿ":
                out.append((x, y, char, True))
    taken = [(a, b) for a, b, _, _ in out]
    parts, at = [], 0
    for a, b in sorted(taken):  # what is explained already says nothing about other encodings
        parts += [text[at:a], " " * (b - a)]
        at = b
    rest = "".join(parts) + text[at:]
    extra = [(a, b, back, True) for a, b, back in _one_byte_words(rest)]
    for a, b in words:
        extra.append((a, b, _mixed_word(text[a:b]), True))
    covered = bytearray(len(text))
    for a, b in taken:
        covered[a:b] = b"\x01" * (b - a)
    for a, b, back, ok in extra:
        if not any(covered[a:b]):
            out.append((a, b, back, ok))
            covered[a:b] = b"\x01" * (b - a)
    return sorted(out)


def _latin(c: str) -> bool:
    return bool(c) and ("a" <= c.lower() <= "z" or "À" <= c <= "ɏ")


def _open_quote(text: str, at: int) -> bool:
    """Whether a quotation is open at this place."""
    for k in range(at - 1, max(-1, at - 200), -1):
        if text[k] in _OPENING:
            return True
        if text[k] in _CLOSING and not text[k + 1 : k + 2].isalpha():
            return False
    return False


def _mixed_word(word: str) -> str:
    """Latin word with letters of another script that stand for its accented ones."""
    best, most = word, -1
    for wrong in ("cp1251", "koi8-r", "cp866", "cp1253"):
        back = "".join(c if c.isascii() else (_turn_back(c, wrong, "cp1252") or c) for c in word)
        score = sum(c in "àáâãäåæçèéêëìíîïñòóôõöøùúûüýßÀÁÂÄÇÉÊÖÜÑÓÚ’–" for c in back)
        if score > most:
            best, most = back, score
    return best


def restore(text: str | None) -> tuple[str | None, int, int]:
    """The text with garbled places replaced, the number of places, and of those that could not be restored."""
    spans = garbled_spans(text)
    if not spans:
        return text, 0, 0
    parts, at = [], 0
    for a, b, back, _ in spans:
        parts += [text[at:a], back]
        at = b
    return "".join(parts) + text[at:], len(spans), sum(not ok for *_, ok in spans)


def garbled_fields(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """`key`, field, garbled, restored, places, lost: every field with a garbled place, once per key.

    Null and empty texts have none. Texts of any length are searched whole in linear time; repeated rows count once; only
    the affected rows are shuffled. `lost` counts the places of which the original is gone.
    """
    src = spread(rows.select(F.col(key).cast("string").alias("k"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, field in enumerate(fields):
                for k, t in zip(batch["k"], batch[f"f{i}"], strict=True):
                    fixed, places, lost = restore(t)
                    if places:
                        out.append((k, field, t, fixed, places, lost))
            if out:
                yield pd.DataFrame(out, columns=["k", "field", "garbled", "restored", "places", "lost"])

    found = src.mapInPandas(run, "k string, field string, garbled string, restored string, places int, lost int")
    return found.dropDuplicates(["k", "field"]).select(F.col("k").cast(rows.schema[key].dataType).alias(key), "field", "garbled", "restored", "places", "lost")
