"""Personal data: candidate gradient boosting.

Fixed patterns give the base spans, which always stay. High-recall generators propose further, overlapping spans (spelled
out addresses, numbers without a plus, account and insurance numbers, and the parts of what fails a base check: items beside
other numbers). Boosted trees score each proposal from its format and its context, and those past their kind's
calibrated threshold that overlap no chosen span are added.

The trees are fitted on two sources. One is the documents themselves, all of them: their base spans, in the words around
them, are rewritten so that the base patterns fail (spelled out, without a plus, beside other numbers), look-alikes are put
in their places, and what is proposed in documents besides is taken as no personal data where its format proves nothing.
The other is generated sentences with cues, for kinds and cues that the documents lack. Both are split into a part to fit on
and a part to calibrate on.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.llm.boosting import BoostedTrees, Rows, rows_of
from docpipe.llm.common import bounded_batches, drop_since, made, materialize, partitions, slices, text_or_empty

# The kinds in their order, and the base patterns.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match never begins inside a run of digits: so long runs are read once
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Precision that each kind's threshold keeps on examples held out of the fit, how many of them it takes to set one, and the
#: probability from which proposals of kinds with fewer are added.
PRECISION, LEAST_HELD_OUT, THRESHOLD = 0.99, 20, 0.98
CONTEXT = 40

# What proposals look like.
PROPOSALS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)| dot |\.) ?[A-Za-z0-9-]{2,24}){1,3}", re.I)),
    ("phone", re.compile(r"(?<![\w.+-])\(?[0-9]{2,4}\)?(?:[ ./-][0-9]{2,5}){2,4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.+-])00[1-9][0-9 ()/-]{7,18}[0-9](?!\w)")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
)
CUES = {
    "email": ("mail", "contact", "write", "reach", "kontakt", "correo"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "master", "credit", "pay", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "llam", "appel", "cell"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte", "transfer"),
    "ssn": ("ssn", "social", "security", "insurance", "taxpayer"),
}
AGAINST = ("version", "order", "isbn", "part", "model", "page", "ref", "invoice", "ticket", "build", "score", "figure", "serial", "date")
CUE_WORDS = {kind: re.compile(r"(?<![a-z])(?:" + "|".join(words) + ")") for kind, words in CUES.items()}
NO_CUE_WORDS = re.compile(r"(?<![a-z])(?:" + "|".join(AGAINST) + ")")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


#: A digit's value in Luhn's sum, as it is and doubled.
LUHN = {str(d): (d, d * 2 - 9 * (d > 4)) for d in range(10)}


def iban_fits(text: str) -> bool:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches: each starts where the run of local characters before an @ does."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    return out


DIGIT = re.compile(r"[0-9]")
GROUP = re.compile(r"[0-9]+")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
PLUS = re.compile(r"\+[0-9][\x20()./0-9-]*[0-9]")
DATE = re.compile(r"(?<![0-9])(?:19|20)[0-9]{2}-[01][0-9]")
DATE_NEXT = re.compile(r" (?:(?:19|20)[0-9]{2}-[01][0-9]|[0-3]?[0-9][./][01]?[0-9][./](?:19|20)|[01][0-9]/[0-9]{2}(?![0-9]))")


def octet(part: str) -> bool:
    """Whether a number of any length, with zeros before it or not, is at most 255."""
    plain = part.lstrip("0")
    return len(plain) <= 3 and int(plain or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of the fixed patterns' matches that pass their checks, by start, then kind as listed."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(map(octet, m.group().split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[0], BASE_KINDS.index(s[2])))


def digit_groups(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in GROUP.finditer(text, start, end)]


def card_parts(text: str, groups: list[tuple[int, int]], least: int = 1) -> list[tuple[int, int, str]]:
    """Sub-runs of at least `least` whole groups that have 12 to 19 digits and pass Luhn."""
    out = []
    for i, (start, _) in enumerate(groups):
        n, single, double, j = 0, 0, 0, i  # Luhn's sums of the digits so far with the last one as it is, and doubled
        while j < len(groups) and n + groups[j][1] - groups[j][0] <= 19:
            a, b = groups[j]
            for c in text[a:b]:
                single, double = double + LUHN[c][0], single + LUHN[c][1]
            n, j = n + b - a, j + 1
            if n >= 12 and single % 10 == 0 and j - i >= least:
                out.append((start, b, "card"))
    return out


def failed_parts(text: str) -> list[tuple[int, int, str]]:
    """What a base match that fails its check may hold beside other numbers; parts of sound matches overlap these.

    Cards in runs of digit groups and in dotted ones, quads inside longer dotted runs, pieces of 9 to 15 digits after a plus.
    """
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            out += card_parts(text, digit_groups(text, *m.span()))
    for m in DOTTED.finditer(text) if "." in text else ():
        groups = digit_groups(text, *m.span())
        out += card_parts(text, groups, 2)
        small = [octet(text[a:b]) for a, b in groups] if len(groups) > 4 else []
        out += [(groups[i][0], groups[i + 3][1], "ip") for i in range(len(small) - 3) if all(small[i : i + 4])]
    for m in PLUS.finditer(text) if "+" in text else ():
        digits = 0
        for a, b in digit_groups(text, *m.span()):
            digits += b - a
            if digits > 15:
                break
            if digits >= 9 and text.count("(", m.start(), b) == text.count(")", m.start(), b):
                out.append((m.start(), b, "phone"))
    return out


def proposals(text: str) -> list[tuple[int, int, str]]:
    numbers = DIGIT.search(text)
    if not numbers and not re.search(r"\bat\b|\[at\]|\(at\)", text, re.I):
        return []
    out = [(m.start(), m.end(), kind) for kind, pattern in PROPOSALS for m in pattern.finditer(text)]
    return out + failed_parts(text) if numbers else out


def free(found: list[tuple[int, int, str]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans of `found` that overlap no base span."""
    ends = sorted((b, a) for a, b, _ in base)
    lows = [a for _, a in ends]
    for i in range(len(lows) - 2, -1, -1):
        lows[i] = min(lows[i], lows[i + 1])
    out = []
    for s in found:
        at = bisect_left(ends, (s[0] + 1, -1))  # the first base span that ends after the start
        if at == len(ends) or lows[at] >= s[1]:
            out.append(s)
    return out


def brand_fits(digits: str) -> bool:
    """Whether a number begins and is as long as those of the large card schemes."""
    n, two = len(digits), digits[:2]
    return (digits[:1] == "4" and n in (13, 16, 19)) or (n == 16 and (two in ("51", "52", "53", "54", "55", "65") or "2221" <= digits[:4] <= "2720" or digits[:4] == "6011")) or (n == 15 and two in ("34", "37")) or (n == 14 and two in ("30", "36", "38"))


def features(text: str, span: tuple[int, int, str]) -> list[float]:
    start, end, kind = span
    inside, before, after = text[start:end], text[max(0, start - CONTEXT) : start].lower(), text[end : end + CONTEXT // 2].lower()
    digits = "".join(c for c in inside if "0" <= c <= "9")
    groups = [len(x) for x in re.findall(r"[0-9]+", inside)]
    tail = inside.rpartition(".")[2].lower()
    cue = lambda words, where: float(bool(words.search(where)))
    last, following = re.search(r"([0-9]+)[ ./-]$", before), re.match(r"[ ./-]([0-9]+)", after)
    return [
        *(float(kind == k) for k in KINDS),
        len(inside), len(digits), len(groups), max(groups, default=0), min(groups, default=0),
        float(luhn(digits)) if digits else 0.0, float(kind == "iban" and iban_fits(inside)),
        float(inside.startswith("(")), float(inside.startswith("00")), inside.count(" "), inside.count("-"), inside.count("."), inside.count("/"),
        float("[" in inside or "(at" in inside.lower()), float(" dot " in inside.lower() or "[dot]" in inside.lower() or "(dot)" in inside.lower()),
        float(tail in ("com", "org", "net", "edu", "de", "fr", "es", "io", "gov", "info")),
        cue(CUE_WORDS[kind], before), cue(CUE_WORDS[kind], after), cue(NO_CUE_WORDS, before), float(before[-1:].isdigit()), float(after[:1].isdigit()),
        float(inside.startswith("+")), len(last[1]) if last else 0, len(following[1]) if following else 0, float(brand_fits(digits)),
        float(kind == "card" and any(brand_fits(x) and luhn(x) for x in re.findall(r"[0-9]+", text[max(0, start - 20) : start] + " " + text[end : end + 20]))),
        float(len(groups) == 1 or (set(groups[:-1]) == {4} and groups[-1] <= 4)), float(len(set(re.findall(r"[ ./-]", inside)))),
        float(bool(DATE_NEXT.match(after))), float(bool(DATE.search(text, start, min(len(text), end + 3)))),
        float(kind == "ssn" and digits[:3] not in ("000", "666") and digits[:1] != "9" and digits[3:5] != "00" and digits[5:] != "0000"),
    ]


class Inventor:
    """Items, numbers and look-alikes drawn from a seed."""

    def __init__(self, seed: int | str):
        self.rng = random.Random(seed)

    def digits(self, k: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(k))

    def word(self) -> str:
        return "".join(self.rng.choice("aeioubcdlmnrstv") for _ in range(self.rng.randint(2, 9)))

    def iban(self) -> str:
        body = self.digits(self.rng.choice((14, 16, 18)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
        plain = f"DE{check:02d}{body}"
        return plain if self.rng.random() < 0.5 else " ".join(plain[i : i + 4] for i in range(0, len(plain), 4))

    def card(self) -> str:
        start, n = self.rng.choice((("4", 16), ("4", 16), (str(self.rng.randint(51, 55)), 16), (self.rng.choice(("34", "37")), 15), ("6011", 16)))
        body = start + self.digits(n - 1 - len(start))
        return body + next(c for c in "0123456789" if luhn(body + c))

    def grouped(self, plain: str, by: str) -> str:
        return by.join(plain[i : i + 4] for i in range(0, len(plain), 4))

    def date(self) -> str:
        return f"{self.rng.randint(1990, 2039)}-{self.rng.randint(1, 12):02d}-{self.rng.randint(1, 28):02d}"

    def number(self) -> str:
        return self.rng.choice((self.digits(self.rng.randint(1, 4)), self.digits(self.rng.randint(1, 3)), self.digits(self.rng.randint(5, 8)), self.date(), f"{self.rng.randint(1, 12):02d}/{self.rng.randint(24, 39)}"))

    def spelled(self, name: str, host: str) -> str:
        at, dot = self.rng.choice(((" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", ".")))
        return f"{name}{at}{host.replace('.', dot)}"

    def phone_beside(self, one: str) -> list[tuple[str, str | None]]:
        rng = self.rng
        return [(one, "phone"), (" ", None), rng.choice(((f"{self.date()} {self.digits(rng.randint(1, 4))}", None), (self.date(), None), (self.card(), "card"), (self.digits(rng.randint(8, 12)), None)))]

    def ip_beside(self, quad: str) -> list[tuple[str, str | None]]:
        rng = self.rng
        return [(f"{rng.choice((rng.randint(256, 999), rng.randint(1000, 65535)))}.", None), (quad, "ip"), (rng.choice(("", "", "", f".{rng.randint(256, 65535)}")), None)]

    def card_beside(self, plain: str) -> list[tuple[str, str | None]]:
        rng = self.rng
        if rng.random() < 0.25:
            return [(self.grouped(plain, "."), "card")]
        by, side = rng.choice(("", " ", "-")), rng.random()
        out: list[tuple[str, str | None]] = [(self.grouped(plain, by), "card")]
        if side < 0.4:
            out = [(self.number(), None), (" ", None), *out]
        if side > 0.3:
            out += [(" ", None), (self.grouped(self.card(), by), "card") if rng.random() < 0.5 else (self.number(), None)]
        return out

    def failing(self) -> tuple[str, list[tuple[str, str | None]]]:
        """The kind of an item that stands beside other numbers, and all pieces of text with the kinds of those that are items."""
        rng, kind = self.rng, self.rng.choice(("card", "card", "ip", "phone"))
        if kind == "phone":
            country = rng.choice(("1", "49", "44", "33", "34", "39", "351", "420"))
            if rng.random() < 0.25:
                return kind, [(f"+{country} {self.digits(rng.choice((2, 3)))}/{self.digits(rng.choice((6, 7)))}", kind)]
            d = self.digits
            return kind, self.phone_beside(rng.choice((f"+{country} {d(rng.choice((2, 3)))} {d(7)}", f"+{country} ({d(2)}) {d(7)}", f"+{country}{d(rng.choice((9, 10)))}", f"+{country} {d(3)} {d(3)} {d(4)}", f"+{country}-{d(3)}-{d(3)}-{d(4)}")))
        if kind == "ip":
            return kind, self.ip_beside(".".join(str(rng.randint(0 if i else 1, 255)) for i in range(4)))
        return kind, self.card_beside(self.card())

    def look_alike(self) -> str:
        """Numbers that fail a base check as a whole and hold no item."""
        rng, digits = self.rng, self.digits
        return rng.choice((" ".join(digits(rng.randint(1, 6)) for _ in range(rng.randint(5, 14))), "-".join(digits(rng.randint(2, 5)) for _ in range(rng.randint(4, 8))), " ".join(digits(rng.choice((8, 12, 13, 14, 16))) for _ in range(rng.randint(2, 4))), ".".join(str(rng.randint(0, 30)) for _ in range(rng.randint(5, 8))), f"{rng.randint(1990, 2039)}.{'.'.join(str(rng.randint(0, 31)) for _ in range(rng.randint(4, 6)))}", ".".join(digits(rng.randint(2, 5)) for _ in range(rng.randint(4, 7))), f"+{digits(rng.randint(1, 3))} {' '.join(digits(rng.randint(1, 6)) for _ in range(rng.randint(4, 9)))}", f"+{digits(2)}.{digits(2)} {' '.join(f'{digits(2)}.{digits(2)}' for _ in range(rng.randint(3, 6)))}"))

    def good(self) -> tuple[str, str]:
        rng, digits, kind = self.rng, self.digits, self.rng.choice(("email", "phone", "phone", "iban", "ssn"))
        if kind == "email":
            return kind, self.spelled(f"{self.word()}.{self.word()}", f"{self.word()}.{rng.choice(('com', 'org', 'net', 'de'))}")
        if kind == "phone":
            return kind, rng.choice((f"({digits(3)})-{digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}", f"0049 {digits(3)} {digits(7)}", f"{digits(3)}.{digits(3)}.{digits(4)}"))
        if kind == "iban":
            return kind, self.iban()
        return kind, f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"

    def bad(self) -> str:
        digits, word = self.digits, self.word
        return self.rng.choice((f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(3)} {digits(2)} {digits(3)}", f"{digits(3)}-{digits(2)}-{digits(4)}", f"{digits(2)}-{digits(2)}-{digits(3)}-{digits(2)}", f"{word()} at {word()}.{word()}", f"{word()} at {word()} dot {word()}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"00{digits(9)}", f"AB{digits(2)} {digits(4)} {digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}"))

    def rewritten(self, kind: str, item: str) -> list[tuple[str, str | None]]:
        """A base item of a document in a form that the base patterns miss, in pieces with their kinds."""
        rng = self.rng
        if kind == "email":
            name, _, host = item.partition("@")
            return [(self.spelled(name, host), kind)]
        if kind == "ip":
            return self.ip_beside(item)
        if kind == "card":
            return self.card_beside("".join(c for c in item if c.isdigit()))
        return self.phone_beside(item) if rng.random() < 0.7 else [("00" + item[1:], kind)]


def proposed(before: str, pieces: list[tuple[str, str | None]], after: str) -> Iterator[tuple[list[float], float]]:
    """Features of the proposals that meet the pieces between two contexts, and whether each is just one of the items."""
    items, at = set(), len(before)
    for piece, kind in pieces:
        items |= {(at, at + len(piece), kind)} if kind else set()
        at += len(piece)
    text = before + "".join(piece for piece, _ in pieces) + after
    for span in free(proposals(text), base_spans(text)):
        if span[0] < at and span[1] > len(before):
            yield features(text, span), float(span in items)


def examples(n: int = 18000, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Proposals in generated sentences, with whether each is personal data."""
    make = Inventor(seed)
    rng, x, y = make.rng, [], []
    while len(x) < n:
        real, beside = rng.random() < 0.5, rng.random() < 0.5
        kind, value = (make.failing() if beside else make.good()) if real else (None, make.look_alike() if beside else make.bad())
        cue = rng.choice(CUES[kind]) if real and rng.random() < 0.85 else rng.choice(AGAINST) if not real and rng.random() < 0.6 else make.word()
        if real and cue not in CUES[kind] and kind not in ("iban", "card"):
            real = False  # without a cue a bare number is no evidence
        pieces = value if isinstance(value, list) else [(value, kind)]
        if not real:
            pieces = [(piece, None) for piece, _ in pieces]
        for row, good in proposed(f"{make.word()} {make.word()} {cue}{rng.choice((': ', ' ', ' is ', ' no. '))}", pieces, f" {make.word()} {make.word()}."):
            x.append(row)
            y.append(good)
    return np.array(x[:n]), np.array(y[:n])


Snippet = tuple[str, str, str, str, bool]


def spans_of(text: str) -> Iterator[Snippet]:
    """A few words around each base span of a text, and around each other proposal that can be an example."""
    base = base_spans(text)
    other = [s for s in free(proposals(text), base) if s[2] in UNPROVEN]
    for spans, is_base in ((base, True), (other, False)):
        for a, b, kind in spans:
            yield text[max(0, a - CONTEXT) : a], text[a:b], text[b : b + CONTEXT], kind, is_base


def snippet_table(docs: DataFrame) -> DataFrame:
    """before, item, after, kind of all base spans and other proposals of all documents (base: True), each once.

    Nothing is left out: a task returns some words for each span, never texts, and equal ones are made one by a shuffle.
    """

    def run(batches):
        for _, texts in slices(batches, "text"):
            found = [s for text in texts for s in spans_of(text)]
            for i in range(0, len(found), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found[i : i + 10_000], strict=True), SNIPPET, strict=True)], schema=SNIPPET)

    spans = docs.select(text_or_empty().alias("text")).mapInArrow(run, "before string, item string, after string, kind string, base boolean")
    return spans.repartition(partitions(docs.sparkSession), *SNIPPET.names).distinct()  # a few bytes each, but work: not to be coalesced


def snippets(docs: DataFrame) -> list[Snippet]:
    """The rows of snippet_table in order, for a look at a small table; `fitted` leaves them where they are."""
    return sorted(tuple(r) for r in snippet_table(docs).collect())


SNIPPET = pa.schema([("before", pa.string()), ("item", pa.string()), ("after", pa.string()), ("kind", pa.string()), ("base", pa.bool_())])
#: Kinds whose proposals come without a proof of format, so that those found in documents are examples against them.
UNPROVEN = ("email", "phone", "ssn")


def to_fit(snippet: Snippet) -> bool:
    """Two thirds of the snippets are fitted on, by their contents; the others are held out."""
    return crc32("\0".join(map(str, snippet)).encode()) % 3 != 0


def examples_of(snippet: Snippet, seed: int = 9) -> list[tuple[list[float], float]]:
    """The examples that one snippet makes, the same wherever it is met."""
    before, item, after, kind, base = snippet
    make, rows = Inventor(f"{seed} {snippet}"), []
    if base:
        for _ in range(3):
            rows += proposed(before, make.rewritten(kind, item), after)
            rows += proposed(before, [(make.look_alike() if make.rng.random() < 0.5 else make.bad(), None)], after)
    elif kind in UNPROVEN:
        rows += proposed(before, [(item, None)], after)
    return rows


def corpus_examples(found: Iterable[Snippet], seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Proposals in the documents' own words: rewritten base items, look-alikes in their places, and what was proposed there.

    Proposals of cards, addresses and account numbers come with a proof of format, so those found in documents are not
    taken as examples against it.
    """
    rows = [r for snippet in found for r in examples_of(snippet, seed)]
    return np.array([r for r, _ in rows]).reshape(-1, N_FEATURES), np.array([g for _, g in rows])


def threshold_of(p: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, precision: float = PRECISION) -> float:
    """The probability from which proposals of a kind are added: between the lowest one down to which the share of personal data
    is at least `precision`, and the next lower one. No probability is enough where none has that share. y: how many of the n
    (1 by default) with a probability are personal data."""
    order = np.argsort(-p, kind="stable")
    p, share = p[order], np.cumsum(y[order]) / np.cumsum((np.ones(len(p)) if n is None else n)[order])
    last = np.append(p[1:] < p[:-1], True)  # equal probabilities go together
    good = np.flatnonzero(last & (share >= precision))
    if not len(good):
        return 1.01
    below = p[good[-1] + 1] if good[-1] + 1 < len(p) else 0.0
    return float((p[good[-1]] + below) / 2)


#: Of kind (a number), margin: how many examples have it, and how many of them are personal data.
Counts = list[tuple[int, float, int, int]]


def counted(kinds: np.ndarray, margin: np.ndarray, good: np.ndarray) -> Counts:
    keys, at = np.unique(np.stack([kinds, margin], axis=1), axis=0, return_inverse=True)
    n, of = np.bincount(at.ravel(), minlength=len(keys)), np.bincount(at.ravel(), good, len(keys))
    return [(int(k), float(m), int(a), int(b)) for (k, m), a, b in zip(keys.tolist(), n.tolist(), of.tolist(), strict=True)]


class Trees(BoostedTrees):
    """Boosted trees with a threshold for each kind of proposal."""

    thresholds: dict[str, float]

    def set_thresholds(self, sources: list[Counts]) -> Trees:
        """Calibrates by all examples held out, and sets each kind's threshold by the last source with enough examples of both
        sorts, so by the documents' own words where they have them."""
        held = [np.array(sorted(counts), float).reshape(-1, 4).T for counts in sources]
        self.calibrate(*np.concatenate(held, axis=1)[1:])
        self.thresholds = dict.fromkeys(KINDS, THRESHOLD)
        for kinds, margin, n, good in held:
            p = self.likely(margin)
            for i, kind in enumerate(KINDS):
                mine = kinds == i
                if n[mine].sum() >= LEAST_HELD_OUT and 0 < good[mine].sum() < n[mine].sum():
                    self.thresholds[kind] = threshold_of(p[mine], good[mine], n[mine])
        return self

    def held_out(self, x: np.ndarray, y: np.ndarray) -> Counts:
        return counted(kind_of(x), self.margin(x), y)


def kind_of(x: np.ndarray) -> np.ndarray:
    return x[:, : len(KINDS)].argmax(1)


@cache
def generated(n: int = 18000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Generated examples, two thirds to fit on and the others held out."""
    x, y = examples(n)
    return x[: n * 2 // 3], y[: n * 2 // 3], x[n * 2 // 3 :], y[n * 2 // 3 :]


def trained(found: list[Snippet]) -> Trees:
    """Trees fitted on two thirds of the examples of both sources; calibration and thresholds by kind come from the rest."""
    x, y, held_x, held_y = generated()
    trees = Trees(trees=60).cut(x)
    own, own_y = corpus_examples(filter(to_fit, found))
    trees.fit([Rows(trees.binned(x), y), Rows(trees.binned(own), own_y)])
    rest = corpus_examples(s for s in found if not to_fit(s))
    return trees.set_thresholds([trees.held_out(held_x, held_y), trees.held_out(*rest)])


def fitted(docs: DataFrame) -> Trees:
    """The trees of `trained` for the snippets of all documents, which stay where they are: examples are made, summed up for each
    level of each tree, and counted by kind and margin in tasks. The same for the same rows, however they are dealt."""
    since = made()
    x, y, held_x, held_y = generated()
    trees = Trees(trees=60).cut(x)

    def make(batches):
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for i in range(0, len(rows), 500):
                for fit in (True, False):
                    own, good = corpus_examples(s for s in rows[i : i + 500] if to_fit(s) == fit)
                    if len(good):
                        binned = pa.array([row.tobytes() for row in trees.binned(own)], pa.binary())
                        yield pa.RecordBatch.from_arrays([binned, pa.array(good, pa.int64()), pa.array(kind_of(own), pa.int32()), pa.array([fit] * len(good))], ["binned", "good", "kind", "fit"])

    rows = snippet_table(docs).mapInArrow(make, "binned binary, good long, kind int, fit boolean").groupBy("fit", "kind", "binned")
    table = materialize(rows.agg(F.count("*").alias("n"), F.sum("good").alias("good")), "examples")
    trees.fit([Rows(trees.binned(x), y), rows_of(table.where("fit"), N_FEATURES)])

    def judge(batches):
        for batch in batches:
            if batch.num_rows:
                binned = np.frombuffer(b"".join(batch.column("binned").to_pylist()), np.uint8).reshape(-1, N_FEATURES)
                yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(trees.binned_margin(binned)), batch.column("n"), batch.column("good")], ["kind", "margin", "n", "good"])

    judged = table.where("not fit").mapInArrow(judge, "kind int, margin double, n long, good long").groupBy("kind", "margin").agg(F.sum("n"), F.sum("good"))
    trees.set_thresholds([trees.held_out(held_x, held_y), [tuple(r) for r in judged.collect()]])
    drop_since(docs.sparkSession, since)
    return trees


@cache
def model() -> Trees:
    """Fitted on generated sentences alone; the same in every process."""
    return trained([])


N_FEATURES = len(features("x", (0, 1, "email")))


def added_spans(text: str, base: list[tuple[int, int, str]], trees: Trees) -> list[tuple[int, int, str]]:
    """Proposals past their kind's threshold that overlap neither a base span nor a likelier proposal."""
    found = free(proposals(text), base)
    if not found:
        return []
    found = sorted(set(found), key=lambda s: (s[0], s[1], KINDS.index(s[2])))
    p, out = trees.probability(np.array([features(text, s) for s in found])), []
    for i in np.argsort(-p, kind="stable").tolist():
        if p[i] < trees.thresholds[found[i][2]]:
            continue
        at = bisect_left(out, found[i])  # the chosen ones overlap nowhere, so only neighbours can
        if all(found[i][0] >= b[1] or b[0] >= found[i][1] for b in out[max(0, at - 1) : at + 1]):
            insort(out, found[i])
    return out


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def find(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and spans of each row.

    Null texts count as empty: no spans, the hash of the empty string. Repeated rows repeat, null ids stay, empty tables
    give no rows, other columns are not read. Of equally likely proposals that overlap the first in order of place is
    added. A pass over all texts to fit the trees (`trees`: fitted ones), then one narrow pass over whole texts; offsets
    count code points.
    """
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(trees or fitted(docs))

    def run(batches):
        for batch, texts in slices(batches, "text"):
            base = [base_spans(text) for text in texts]
            spans = [listed(b + added_spans(t, b, held.value)) for t, b in zip(texts, base, strict=True)]
            counts = [pa.array([sum(s[2] == kind for s in b) for b in base], pa.int64()) for kind in BASE_KINDS]
            shas = pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, shas, pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Overlapping spans are merged and named after the first."""
    out, at = [], 0
    merged: list[list] = []
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    for start, end, kind in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """`docs` with every span of its texts replaced by its kind in brackets, and n_chars, if there, counted anew.

    Null texts stay null, empty ones empty; repeated rows repeat; other columns stay as they are, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(trees or fitted(docs))

    def run(batches):
        for batch, texts in slices(batches, "text"):
            known, out = batch.column("text").is_valid().to_pylist(), []
            for text in texts:
                base = base_spans(text)
                spans = base + added_spans(text, base, held.value)
                out.append(redact_text(text, spans) if spans else text)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array([t if k else None for t, k in zip(out, known, strict=True)], batch.schema.field(at).type))

    done = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return done
