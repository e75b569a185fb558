"""Trains the weights of pii.py: python -m scriptorium.llm.pii_train. Deterministic; about a minute.

The sentences are made here from templates with invented names and numbers, each token labelled by how it was made.
Training maximises the pseudo-likelihood (every token given its neighbours by chain and skip edges), first of features and
chain potentials, then of the skip potentials alone, so that what a place says by itself isn't left to its repetition. Some
texts say only once, and far away, what a number is or whose family name stands alone.
"""

from __future__ import annotations

import json
import os
import random

import numpy as np

from scriptorium.llm import pii
from scriptorium.llm.pii import LABELS, Field, Model, Names, field_of

#: Sentences to train on and to test on, and rounds of gradient ascent.
TRAIN, TEST, EPOCHS, RATE, DECAY = 12_000, 2_000, 250, 0.15, 1e-4
#: Rounds of them for the skip potentials.
SKIP_EPOCHS = 60

GIVEN = "Alma Bruno Cora Dorian Edda Faro Gwen Hilmar Ines Jorun Kasimir Livia Marek Nelly Osric Pippa Quentin Runa Silvan Tilda Ulric Vera Wanda Xaver Yara Zeno".split()
FAMILY = "Ashgrove Birkwald Corvane Dunmarsh Elmsworth Farrowby Greymoor Haldane Ilverton Jorvik Keldbeck Lormont Merrowdale Netherby Oxcombe Pellworth Quarrington Rosshaven Stannard Tolworth Underhay Varnholt Westerlund Yarrowby".split()
FIGURES = "Azor Belkin Cadmiel Doran Ezrel Ketura-Lin Malchon Nerith Obadan Pelith Saffira Tirzal".split()
PLACES = ["Amber Wells", "North Corrie", "Fallowmere", "Stonehithe", "Lower Brenn", "Westry"]
NOUNS = "road river lamp bread song elder sister stranger door house letter mercy silence harvest cup shepherd way street box court lane hill".split()
PROSE = "the a of near with before after and but they we he she carried opened kept lost heard sent old quiet bright at by for in on from to this that was is".split()


def number(r: random.Random, form: str) -> str:
    return "".join(str(r.randint(0, 9)) if c == "9" else r.choice("ABCHKLXZ") if c == "A" else c for c in form)


class Maker:
    """Makes labelled sentences: lists of (text, label) pieces."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def prose(self) -> list[tuple[str, str]]:
        r = self.r
        words = [r.choice(PROSE + NOUNS) if r.random() < 0.9 else r.choice(FIGURES) for _ in range(r.randint(3, 10))]
        words[0] = words[0].capitalize()
        ref = f" ({r.choice(FIGURES)} {r.randint(1, 60)}:{r.randint(1, 40)})" if r.random() < 0.15 else ""
        return [(" ".join(words) + ref + r.choice([".", ".", "?", ","]), "O")]

    def name(self) -> list[tuple[str, str]]:
        r = self.r
        g, f, i = r.choice(GIVEN), r.choice(FAMILY), r.choice("ABCDEFGHLMRST")
        title = r.choice(["Mr", "Mrs", "Dr.", "Rev.", "Sister", "Elder", "Pastor", "Prof."])
        form = r.choice([f"{g} {f}"] * 4 + [f"{g} {i}. {f}", f"{i}. {f}", f"{f}, {g}", f"{title} {f}", f"{title} {g} {f}"])
        if r.random() < 0.25:
            form = r.choice([form.upper(), form.lower()])
        return [(form, "name")]

    def email(self) -> list[tuple[str, str]]:
        r = self.r
        g, f = r.choice(GIVEN).lower(), r.choice(FAMILY).lower()
        local = r.choice([f"{g}.{f}", f"{f}_{g}{r.randint(1, 99)}", f"{g}+list", f"{g[0]}{f}", f"{g}-{f[:4]}"])
        host = r.choice(["mail.example", "brook.test", "abc.example.org", "post.invalid", "mail.westry.example", "brook-notes.example.net"])
        at, dot = r.choice([("@", ".")] * 5 + [(" @ ", "."), ("[at]", "[dot]"), (" (at) ", "."), (" at ", " dot "), ("@\n", ".")])
        out = local.replace(".", dot if dot == " dot " else ".") + at + host.replace(".", dot)
        return [(out.upper() if r.random() < 0.1 else out, "email")]

    def phone(self) -> list[tuple[str, str]]:
        r = self.r
        form = r.choice(["+44 7999 999999", "+1 999 999 9999", "(999) 999-9999", "999-999-9999", "999.999.9999", "0999 999 999", "09999 999999", "+49 99 99999 999", "0044 20 9999 9999", "+44 (0)20 9999 9999", "9999999999", "9999999999", "999-9999", "999-9999 ext. 99"])
        if r.random() < 0.05:
            return [(" ".join(r.choice(pii.DIGIT_WORDS[:10]) for _ in range(r.randint(7, 10))), "phone")]
        return [(number(r, form), "phone")]

    def identity(self) -> list[tuple[str, str]]:
        r = self.r
        word, form = r.choice([("SSN", "999-99-9999"), ("social security number", "999 99 9999"), ("NI no.", "AA 99 99 99 A"), ("", "AA999999A"), ("passport", "A99999999"), ("passport no.", "AA 999 9999"), ("national ID", "9999-9999-999"), ("tax id", "99/999/99999"), ("driver licence", "AA-9999-99999"), ("DNI", "99999999-A")])
        n = number(r, form)
        if form.startswith(("AA 99 99", "AA999999A")):
            n = n[:-1] + r.choice("ABCD")
        return [(f"{word} " if word else "", "O"), (n, "id_number")]

    def address(self) -> list[tuple[str, str]]:
        r = self.r
        n, w, p = r.randint(1, 230), r.choice(["Juniper", "Old Mill", "Chapel", "Harbour", "Quarry", "St Alban"]), r.choice(PLACES)
        s = r.choice(["Road", "Rd", "Lane", "Street", "St.", "Ave", "Ave.", "Close", "Terrace", "Way", "Court"])
        code = number(r, "AA9 9AA")
        form = r.choice([f"{n} {w} {s}, {p}", f"{n} {w} {s}", f"Flat {r.randint(1, 20)}, {n} {w} {s}, {p}", f"{n}a {w} {s}", f"{n} {w} {s}, {p} {code}", f"calle {w} {n}, 2º B, {p}", f"{n} rue {w}, {number(r, '99999')} {p}", f"{w.replace(' ', '')}weg {n}, {number(r, '99999')} {p}", f"P.O. Box {n}, {p}", f"PO Box {n}"])
        if r.random() < 0.3:
            form = f"{n} {w} {s}{r.choice([' in ', ', ', ' '])}{p}".lower()
        return [(form, "address")]

    def trap(self) -> list[tuple[str, str]]:
        r = self.r
        g, f = r.choice(GIVEN), r.choice(FAMILY)
        return [(r.choice([
            f"The shelf mark is MS {number(r, '9999-99')}, folio {r.randint(1, 90)}.", f"Catalogue no. 978-{number(r, '9-99-999999-9')} on the cover.", f"ISBN 978-{number(r, '9-9999-9999-9')}.", f"Attendance was {r.randint(20, 300)} in {number(r, '20')}{r.randint(10, 29)}-0{r.randint(1, 9)}-{r.randint(10, 28)}.",
            f"See hymn {number(r, '999')} and hymn {number(r, '0999')}.", f"Read verses {number(r, '999:999-999')} aloud.", f"On the map, grid {number(r, '9999 9999')}.", f"Chapter {r.randint(10, 30)}.{r.randint(10, 30)}.{r.randint(10, 30)} is missing.", f"Version {r.randint(1, 9)}.0.{r.randint(1, 9)} has {number(r, '99999')} verses.",
            f"Order {r.randint(2, 90)} copies at {r.randint(2, 90)} each, lane two of the stockroom.", f"At the crossing of Long Street and the old wall we stopped.", f"The {r.choice(['Elder', 'Sister'])} Council has not replied.", f"{r.choice(FIGURES)} stood near the salt road ({r.choice(FIGURES)} {r.randint(1, 60)}:{r.randint(1, 40)}).",
            f"Compare @margin and @gloss in print.", f"{g} came late, and so did the others.", f"The {f} edition spells it otherwise.", f"Meet at the {r.choice(['Cedar', 'North'])} Chapel at 19:30.", f"Brother {r.choice(FIGURES)} wept.", f"The cart held {number(r, '999')} jars and {number(r, '9999')} loaves.", f"The {f} Hymnal was printed in {number(r, '19')}{r.randint(10, 99)}.",
        ]), "O")]

    def filler(self) -> list[tuple[str, str]]:
        out = []
        for _ in range(self.r.randint(2, 5)):
            out += [*self.prose(), (" ", "O")]
        return out

    def repeated_name(self) -> list[tuple[str, str]]:
        """A full name, and far from it the family name alone; or a figure twice."""
        r = self.r
        if r.random() < 0.25:
            figure = r.choice(FIGURES)
            return [(f"Brother {figure} wept. ", "O"), *self.filler(), (f"Then {figure} stood up.", "O")]
        g, f = r.choice(GIVEN), r.choice(FAMILY)
        full = r.choice([f"{g} {f}", f"{g[0]}. {f}", f"{f}, {g}", f"Mrs {f}", f"Dr. {g} {f}"])
        alone = r.choice([f, f, f.upper(), f.lower(), f + "’s"])
        first = [(r.choice(["Spoke with ", "Notes taken by ", "Pray for "]), "O"), (full, "name"), (". ", "O")]
        last = [(r.choice(["Later ", "In the end ", "We asked ", "The reply of "]), "O"), (alone, "name"), (r.choice([" agreed.", " came too.", " was glad.", "."]), "O")]
        return [*first, *self.filler(), *last] if r.random() < 0.8 else [*last, (" ", "O"), *self.filler(), *first]

    def repeated_number(self) -> list[tuple[str, str]]:
        """A number whose form fits several kinds: what it is is said at one of its two places only."""
        r = self.r
        n = number(r, r.choice(["9999999999", "99999999999"]))
        label, said = r.choice([("phone", "Ring "), ("phone", "tel "), ("phone", "My number is "), ("id_number", "national ID "), ("id_number", "passport no. "), ("id_number", "tax id "), ("O", "Catalogue no. "), ("O", "ISBN "), ("O", "shelf mark ")])
        told, bare = [(said, "O"), (n, label), (". ", "O")], [(r.choice(["It is copied here: ", "Once more: ", "On the back stands ", "Again "]), "O"), (n, label), (r.choice([".", " in pencil.", " below."]), "O")]
        return [*told, *self.filler(), *bare] if r.random() < 0.7 else [*bare, (" ", "O"), *self.filler(), *told]

    def text(self) -> list[tuple[str, str]]:
        r, out = self.r, []
        if r.random() < 0.25:
            out += [*r.choice([self.repeated_name, self.repeated_number])(), (" ", "O")]
        for _ in range(r.randint(1, 4)):
            pick = r.random()
            if pick < 0.3:
                part = self.prose()
            elif pick < 0.48:
                part = self.trap()
            else:
                kind = r.choice(["name", "name", "email", "phone", "identity", "address"])
                before = {"name": ["Notes taken by ", "Spoke with ", "— ", "", "Pray for ", "Question from "], "email": ["Reply: ", "contact ", "Send it to ", "<", ""], "phone": ["tel ", "Ring ", "My number is ", "mob. ", "Call ", "", "The guest left ", "We have ", "On the slip: "], "identity": ["The form shows ", "copied from the card: ", "deposit against "], "address": ["lives at ", "The visit was at ", "Post the book to ", "Return to ", ""]}[kind]
                part = [(r.choice(before), "O"), *getattr(self, kind)(), (r.choice([".", " after the service.", " was written down.", "", " this week.", ",", " since spring.", " if found.", " as the number."] if kind == "phone" else [".", " after the service.", " was written down.", "", " this week.", ",", " since spring.", " if found."]), "O")]
            out += part + [(r.choice([" ", " ", " ", "\n", "\n\n"]), "O")]
        return out


def labelled(n: int, seed: int, make: str = "text") -> list[tuple[str, list[tuple[int, int, str]]]]:
    maker, out = Maker(seed), []
    for _ in range(n):
        text, spans = "", []
        for piece, label in getattr(maker, make)():
            if label != "O":
                spans.append((len(text), len(text) + len(piece), label))
            text += piece
        out.append((text, spans))
    return out


def fields(rows: list[tuple[str, list[tuple[int, int, str]]]], names: Names) -> tuple[list[Field], list[np.ndarray]]:
    out, gold = [], []
    for text, spans in rows:
        f = field_of(text, names)
        if f is None or not f.tokens:
            continue
        y = np.zeros(len(f.tokens), np.int64)
        for i, (_, a, b) in enumerate(f.tokens):
            for s, e, label in spans:
                if s <= a and b <= e:
                    y[i] = LABELS.index(label)
        out.append(f)
        gold.append(y)
    return out, gold


def train(path: str) -> dict[str, float]:
    r = random.Random(7)
    rows = labelled(TRAIN, 1)
    known = {x.lower() for x in FAMILY if r.random() < 0.85}
    names = Names(pii.GIVEN | {x.lower() for x in GIVEN}, known)
    fs, gold = fields(rows, names)
    counts: dict[str, int] = {}
    for f in fs:
        for xs in f.features:
            for x in xs:
                counts[x] = counts.get(x, 0) + 1
    index = {x: i for i, x in enumerate(sorted(x for x, n in counts.items() if n >= 3))}
    k = len(LABELS)
    model = Model(index, np.zeros((len(index), k)), np.zeros((k, k)), np.zeros((2, k, k)))
    edge_kinds = model.graph(fs)[1:]
    pots = [model.chain, *model.skip]
    y = np.concatenate(gold)
    node, col, n = [], [], 0
    for f in fs:
        for xs in f.features:
            for x in xs:
                if x in index:
                    node.append(n)
                    col.append(index[x])
            n += 1
    node, col = np.array(node), np.array(col)  # every token has the feature `bias`, so none is missing in `node`
    by_col = np.argsort(col, kind="stable")
    node_starts, col_starts = np.searchsorted(node, np.arange(n)), np.searchsorted(col[by_col], np.arange(len(index)))
    truth = np.eye(k)[y]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in (model.weights, *pots)]
    for step in range(1, EPOCHS + 1):
        z = np.add.reduceat(model.weights[col], node_starts)
        skipping = step > EPOCHS - SKIP_EPOCHS
        for edges, pot in list(zip(edge_kinds, pots, strict=True))[: 3 if skipping else 1]:
            np.add.at(z, edges[:, 1], pot[y[edges[:, 0]]])
            np.add.at(z, edges[:, 0], pot[:, y[edges[:, 1]]].T)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = truth - p
        grads = [np.zeros_like(w) for w in (model.weights, *pots)]
        grads[0] = np.add.reduceat(d[node[by_col]], col_starts)
        for edges, g in zip(edge_kinds, grads[1:], strict=True):
            np.add.at(g, y[edges[:, 0]], d[edges[:, 1]])
            np.add.at(g.T, y[edges[:, 1]], d[edges[:, 0]])
        chosen = slice(2, 4) if skipping else slice(0, 2)
        for w, g, (m, v) in list(zip((model.weights, *pots), grads, moments, strict=True))[chosen]:
            g = g / n * 100 - DECAY * w
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.999 * v + 0.001 * g * g
            turn = step - (EPOCHS - SKIP_EPOCHS) * skipping
            w += RATE * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        json.dump({"labels": LABELS, "features": sorted(index), "weights": model.weights.round(3).tolist(), "chain": model.chain.round(3).tolist(), "skip": model.skip.round(3).tolist()}, out, ensure_ascii=False)
    pii._load.cache_clear()
    return held_out(names)


def held_out(names: Names | None = None, model: Model | None = None, make: str = "text", n: int = TEST) -> dict[str, float]:
    """Shares of texts whose set of kinds, and whose number of places by kind, is right, on texts that were not trained on."""
    names = names or Names(pii.GIVEN | {x.lower() for x in GIVEN}, {x.lower() for x in FAMILY[::2] + FAMILY[1::4]})
    rows = labelled(n, 2, make)
    got = pii.find_all([t for t, _ in rows], names, model or Model.load())
    pairs = [(sorted(k for *_, k in g), sorted(k for *_, k in s)) for g, (_, s) in zip(got, rows, strict=True)]
    return {"exact": sum(set(g) == set(s) for g, s in pairs) / n, "places": sum(g == s for g, s in pairs) / n}


def without(model: Model, chain: bool = False, skip: bool = False) -> Model:
    """The model with some potentials taken away: what they decide."""
    return Model(model.features, model.weights, model.chain * (not chain), model.skip * (not skip))


if __name__ == "__main__":
    print(train(os.path.join(os.path.dirname(__file__), "models", "pii_crf.json")))
