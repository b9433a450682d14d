"""Personal data by candidates and boosted trees.

Plain patterns give the base spans, which stay. Beside them high-recall generators propose overlapping candidates:
every run of neighbouring digit groups that could be a phone number, a card or an address of a machine, and everything round
an at-sign, spelled out or not. Trees (one model for each kind) judge a candidate by its format and its
surroundings, and spans above a threshold are added, the surest first, where they overlap neither a base span nor each
other. So numbers that the patterns lose because another number stands beside them are found, and
forms that no pattern has, such as phone numbers without a plus or addresses with the at-sign spelled out.

The models are fitted on all distinct texts that have anything to look at. There base spans are true, and other candidates false
unless they touch a number that a pattern dropped (which stays unlabelled). Into copies of the same texts personal data in many forms, and numbers that
are none, are planted at random words, so their truth is known. A fifth of the texts, by a hash, sets the thresholds: the smallest that
leave a precision of ``PRECISION`` there. Executors make the candidates' features, bin them by fixed bounds (``CUTS``) and count equal ones; trees grow from sums over
the whole table of these counts (``boosting.fit_table``).

Lengths of candidates follow public formats: 64 characters before an at-sign, 15 digits of a phone number, 19 of a card, in ``GROUPS`` groups.

Defined results: null and empty texts have no spans; without texts to learn from nothing is added; ids may be null or repeat, since
rows are judged by their text alone; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.llm import textvec as tv
from cairnflow.llm.boosting import Boosted, fit_table, steps
from cairnflow.llm.shared import discard, lean_batches, stored

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.995
#: Upper bounds of the bins of features, which are whole numbers below 1000: small ones stand alone, larger ones follow formats (labels of 63 characters, parts of at most 255).
CUTS = np.array([*range(25), 32, 48, 64, 127, 199, 255])
_BIN = np.searchsorted(CUTS, np.arange(1000)).tolist()
#: Counts that a task holds before it hands them on.
_HELD = 1 << 16
#: Groups of digits that a number is written in, at most.
GROUPS = 8
#: Texts that have something to look at.
_SOME = r"[0-9]|@|[\[(]at[\])]|\x20at\x20[a-z0-9-]+(?:\.[a-z0-9-]|\x20?[\[(]?dot\b)"

# Base patterns. Possessive repeats, and starts at a run's first digit, find the same spans in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Generators.
_AT = re.compile(r"@|[\x20]?[\[(]at[\])][\x20]?|\x20at\x20", re.IGNORECASE)
_LEFT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_RIGHT = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.|[\x20]?[\[(]dot[\])][\x20]?|\x20dot\x20)[A-Za-z0-9-]{1,63}){1,4}", re.IGNORECASE)
_REGION = re.compile(r"[0-9](?:[0-9().\x20+-]*[0-9])?")
_GROUP = re.compile(r"[0-9]+")
#: Words before a number that tell what it is: fixed lists.
_HINTS = (("tel", "phone", "call", "fax", "mobile"), ("card", "visa", "pay", "credit"), ("ip", "host", "server", "addr"), ("mail", "contact", "write"), ("version", "isbn", "date", "order", "serial", "no.", "section", "#"))


def luhn(digits: str) -> bool:
    """Whether the check digit fits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Round each at-sign: the longest run before it, and labels with dots after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def matches(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, whether it stands) of all that the base patterns match."""
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b, True
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        yield "ip", *m.span(), all(len(p) < 4 and int(p or 0) <= 255 for p in parts)
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        yield "card", *m.span(), 14 <= len(digits) <= 19 and luhn(digits)
    if "+" in text:
        for m in _PHONE.finditer(text):
            yield "phone", *m.span(), 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15


def ordered(spans: list[tuple]) -> list[tuple]:
    """By start, then in the order of the kinds."""
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def base(text: str | None) -> list[tuple[str, int, int]]:
    """The spans that the patterns give."""
    return ordered([(k, a, b) for k, a, b, stands in matches(text or "") if stands])


def _side(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3


def _surroundings(text: str, a: int, b: int) -> list[float]:
    before, after = text[max(0, a - 24) : a].lower(), text[b : b + 12]
    return [_side(text[a - 1 : a]), _side(text[b : b + 1]), sum(map(str.isdigit, before)), sum(map(str.isdigit, after)), *(any(w in before for w in words) for words in _HINTS)]


def candidates(text: str) -> Iterator[tuple[str, int, int, list[float]]]:
    """(kind, start, end, features) of all that could be personal data; candidates overlap."""
    for m in _AT.finditer(text):
        left, right = _LEFT.search(text, max(0, m.start() - 64), m.start()), _RIGHT.match(text, m.end())
        if left and right:
            a, b = left.start(), right.end()
            sign, domain = m.group(), right.group().lower()
            how = 0 if sign == "@" else 1 if sign.strip()[0] in "[(" else 2
            labels = re.split(r"[^a-z0-9-]+(?:dot[^a-z0-9-]+)?", domain)
            dots = 1 if "[" in domain or "(" in domain else 2 if " dot " in domain else 0
            local = left.group()
            yield "email", a, b, [how, dots, len(local), len(labels), len(labels[-1]), labels[-1].isalpha(), sum(map(str.isdigit, local)), local[-1] == ".", "." in local, *_surroundings(text, a, b)]
    for region in _REGION.finditer(text):
        if region.end() - region.start() < 7:
            continue
        groups = [g.span() for g in _GROUP.finditer(text, *region.span())]
        for i, (begin, _) in enumerate(groups):
            a = begin
            if a and text[a - 1] == "(":
                a -= 1
            if a and text[a - 1] == "+":
                a -= 1
            digits = ""
            for j in range(i, min(i + GROUPS, len(groups))):
                digits += text[groups[j][0] : groups[j][1]]
                if len(digits) > 19:
                    break
                gap = text[groups[j - 1][1] : groups[j][0]] if j > i else ""
                if len(gap) > 3:
                    break
                b = groups[j][1]
                kinds = [k for k, fits in (("ip", j == i + 3 and not re.search("[^0-9.]", text[begin:b])), ("card", len(digits) >= 14), ("phone", 7 <= len(digits) <= 15)) if fits]
                if kinds:
                    inside = text[a:b]
                    sizes = [y - x for x, y in groups[i : j + 1]]
                    near = begin - groups[i - 1][1] if i else 9, groups[j + 1][0] - b if j + 1 < len(groups) else 9
                    x = [len(digits), len(sizes), sizes[0], sizes[1] if j > i else 0, sizes[-1], min(sizes), max(sizes), *(inside.count(c) for c in " -.()"), inside[0] == "+", inside[0] == "(", luhn(digits), min(999, max(int(text[x:y]) if y - x < 4 else 999 for x, y in groups[i : j + 1]))]
                    x += [int(digits[0]), *(min(n, 9) for n in near), *_surroundings(text, a, b)]
                    for k in kinds:
                        yield k, a, b, x


class Model:
    """Trees and a threshold for each kind."""

    def __init__(self, trees: dict[str, Boosted], thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def added(self, texts: list[str], known: list[list[tuple]]) -> list[list[tuple[str, int, int, float]]]:
        """For each text the candidates that are selected beside its base spans."""
        found: dict[str, list] = {k: [] for k in self.trees}
        for t, text in enumerate(texts):
            for k, a, b, x in candidates(text):
                if k in found:
                    found[k].append((t, a, b, x))
        chosen: list[list] = [[] for _ in texts]
        for k, rows in found.items():
            p = self.trees[k].predict(np.array([r[3] for r in rows], float)) if rows else []
            for (t, a, b, _), score, step in zip(rows, p, steps(p), strict=True):
                if step >= self.thresholds[k]:
                    chosen[t].append((k, a, b, float(score)))
        return [_apart(c, k) for c, k in zip(chosen, known, strict=True)]


def _apart(chosen: list[tuple], known: list[tuple]) -> list[tuple]:
    """The surest spans (then the longest, the first) that touch neither what is known nor each other."""
    taken = sorted((a, b) for _, a, b in known)
    ends = max((b - a for a, b in taken), default=0)
    out = []
    for k, a, b, p in sorted(chosen, key=lambda s: (-s[3], s[1] - s[2], s[1], KINDS.index(s[0]))):
        at = bisect_left(taken, (b, b))
        i, free = at - 1, True
        while i >= 0 and taken[i][0] >= a - ends:
            free &= taken[i][1] <= a
            i -= 1
        if free:
            taken.insert(bisect_left(taken, (a, b)), (a, b))
            ends = max(ends, b - a)
            out.append((k, a, b, p))
    return out


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _word(rng: random.Random, least: int = 3, most: int = 8) -> str:
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(least, most)))


def _card(rng: random.Random, fits: bool = True) -> str:
    body = str(rng.randint(2, 6)) + _digits(rng, 14)
    check = next(c for c in "0123456789" if luhn(body + c))
    n = body + (check if fits else str((int(check) + rng.randint(1, 9)) % 10))
    sep = rng.choice(["", "", " ", "-", ".", "  "])
    return sep.join(n[i : i + 4] for i in range(0, 16, 4))


def _phone(rng: random.Random) -> str:
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    country = rng.choice(["+1", "+44", "+49", "+33", "1", "001", "0049"])
    return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{country} {a} {b} {c}", f"{country} ({a}) {b}-{c}", f"{country}-{a}-{b}-{c}", f"{country} {a} {_digits(rng, 7)}", f"({a}) {b} {c}"])


def _email(rng: random.Random) -> str:
    at = rng.choice(["@", " (at) ", " [at] ", "(at)", "[at]", " at "])
    dot = "." if at in ("@", "(at)", "[at]") else rng.choice([".", " (dot) ", " [dot] ", " dot "] if at != " at " else [" dot "])
    return f"{_word(rng)}{rng.choice(['.', '_', ''])}{_word(rng, 2)}{rng.choice(['', _digits(rng, 2)])}{at}{_word(rng)}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io'])}"


def _ip(rng: random.Random) -> str:
    return ".".join(str(rng.randint(1, 255)) for _ in range(4))


def _other(rng: random.Random) -> str:
    """A number, or something with an at-sign, that is no personal data."""
    d = lambda n: _digits(rng, n)
    year = str(rng.randint(1950, 2030))
    return rng.choice([
        lambda: f"{year}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{rng.randint(10, 28)}.{rng.randint(10, 12)}.{year}", lambda: f"{year}-{rng.randint(10, 12)}-{rng.randint(10, 28)} {rng.randint(10, 23)}:{d(2)}:{d(2)}", lambda: f"{year}{d(4)}",
        lambda: f"{year} - {year}", lambda: _card(rng, False), lambda: f"{d(2)}.{d(1)}.{d(3)}", lambda: f"{d(1)}.{d(1)}.{d(2)}.{d(1)}.{d(4)}", lambda: f"978-{d(1)}-{d(3)}-{d(5)}-{d(1)}", lambda: f"978{d(10)}", lambda: f"{d(4)}.{d(3)}.{d(3)}.{d(2)}",
        lambda: f"{rng.randint(256, 999)}.{d(3)}.{d(2)}.{d(1)}", lambda: f"{d(3)},{d(3)},{d(3)}", lambda: f"{d(7)}.{d(2)}", lambda: f"{d(5)}-{d(4)}", lambda: f"{d(8)}", lambda: f"{d(10)}", lambda: f"{d(12)}", lambda: f"{d(2)} {d(3)} {d(3)}",
        lambda: f"{_word(rng, 1, 3)}{d(9)}{_word(rng, 1, 3)}", lambda: f"#{d(9)}", lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(2)}:{d(2)}:{d(2)}.{d(6)}", lambda: f"{d(20)}", lambda: f"{d(30)}", lambda: f"{_word(rng)} at {_word(rng)}.{_word(rng)}",
        lambda: f"{_word(rng)} at the {_word(rng)}", lambda: f"{_word(rng)}@{_word(rng)}", lambda: f"look at {_word(rng)}.com", lambda: " ".join(d(rng.randint(1, 4)) for _ in range(rng.randint(3, 12))), lambda: "; ".join(f"{d(2)}.{d(4)}" for _ in range(4)),
    ])()


_FORMS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone}


def planted(text: str, rng: random.Random, n: int = 8) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with personal data in many forms, and with other numbers (kind ''), between its words; where these stand."""
    places = sorted(rng.sample(range(len(text) + 1), min(n, len(text) + 1)))
    out, spans, at, before = [], [], 0, 0
    for place in places:
        place = text.find(" ", place) if " " in text[place:] else len(text)
        if place < before:
            continue
        out.append(text[before:place])
        at, before = at + place - before, place
        for _ in range(rng.choice([1, 1, 1, 2, 3])):  # neighbours too
            kind = rng.choice([*KINDS, None, None, None])
            piece = _FORMS[kind](rng) if kind else _other(rng)
            piece = (" " + piece) if kind != "phone" or rng.random() < 0.9 else (" tel: " + piece)
            begin = at + (6 if piece.startswith(" tel: ") else 1)
            spans.append((kind or "", begin, at + len(piece)))
            out.append(piece)
            at += len(piece)
    return "".join([*out, text[before:]]), spans


def _touching(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether a run shares a character with any of the spans."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def touches(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return i > 0 and ends[i - 1] > a

    return touches


def examples(text: str) -> Iterator[tuple[str, int, list[float]]]:
    """(kind, truth, features) of the candidates of a text and of its copy with planted spans."""
    rng = random.Random(zlib.crc32(text.encode("utf-8", "replace")))
    seen = list(matches(text))
    dropped = _touching([(a, b) for _, a, b, stands in seen if not stands])
    true = {(k, a, b) for k, a, b, stands in seen if stands}
    for k, a, b, x in candidates(text):
        if (k, a, b) in true:
            yield k, 1, x
        elif not dropped(a, b):
            yield k, 0, x
    changed, spans = planted(text, rng)
    true, near = set(spans), _touching([(a, b) for _, a, b in spans])
    for k, a, b, x in candidates(changed):
        if near(a, b):
            yield k, int((k, a, b) in true), x


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of examples by kind, bins of features, and whether their text sets thresholds."""
    held: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
    for batch in batches:
        for text in batch.column("text").to_pylist():
            tested = bool(tv.mix(np.array([zlib.crc32(text.encode("utf-8", "replace"))], np.uint64)).view(np.int64)[0] % 5 == 0)
            for k, y, x in examples(text):
                count = held[k, bytes([_BIN[v] for v in x]), tested]
                count[0] += 1
                count[1] += y
                if len(held) >= _HELD:
                    yield _counted(held)
    if held:
        yield _counted(held)


def _counted(held: dict[tuple, list[int]]) -> pa.RecordBatch:
    (kind, x, tested), (n, good) = zip(*held, strict=True), zip(*held.values(), strict=True)
    held.clear()
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(x, pa.binary()), pa.array(tested, pa.bool_()), pa.array(n, pa.int64()), pa.array(good, pa.int64())], names=["kind", "x", "tested", "n", "good"])


def _some(column: pa.Array) -> pa.Array:
    return pa.compute.fill_null(pa.compute.match_substring_regex(column, _SOME, ignore_case=True), False)


def _worth_a_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(_some(batch.column("text")))


def train(docs: DataFrame) -> Model:
    """Models from all distinct texts."""
    lean_batches(docs)
    texts = docs.select("text").mapInArrow(_worth_a_look, "text string").distinct()
    counts = texts.mapInArrow(_examples, "kind string, x binary, tested boolean, n long, good long")
    rows = stored(counts.groupBy("kind", "x", "tested").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "candidates")
    found = Model(*fit_table(rows, CUTS, PRECISION))
    discard(rows)
    return found


_SPANS = "array<struct<kind: string, start: long, end: long{}>>"
_SPAN = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]


def _redacted(text: str, spans: list[tuple]) -> str:
    """The text with the kinds in place of spans; of spans that overlap, the first gives its name to all."""
    out, at = [], 0
    for k, a, b in (s[:3] for s in spans):
        if a >= at:
            out.append(f"{text[at:a]}[{k.upper()}]")
        at = max(at, b)
    return "".join([*out, text[at:]])


def _detect(model: Model, redacted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.pieces(batch):
                column = part.column("text")
                some = _some(column)
                at = np.flatnonzero(np.asarray(some))
                texts = column.filter(some).to_pylist()
                known = [base(t) for t in texts]
                own, spans = [[] for _ in range(part.num_rows)], [[] for _ in range(part.num_rows)]
                for i, b, more in zip(at.tolist(), known, model.added(texts, known), strict=True):
                    own[i], spans[i] = b, ordered([*((*s, 1.0) for s in b), *more])
                names = [n for n, _ in _SPAN]
                made = [
                    pa.array([[dict(zip(names, s, strict=True)) for s in row] for row in own], pa.list_(pa.struct(_SPAN))),
                    pa.array([[dict(zip([*names, "score"], s, strict=True)) for s in row] for row in spans], pa.list_(pa.struct([*_SPAN, ("score", pa.float64())]))),
                ]
                if redacted:
                    made.append(pa.array([t if t is None else _redacted(t, s) for t, s in zip(column.to_pylist(), spans, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], names=["doc_id", "base", "spans", *["redacted"] * redacted])

    return run


def detect(docs: DataFrame, redacted: bool = False) -> DataFrame:
    """One row per document: doc_id, base and all spans (kind, start, end in code points; spans with a score), and with ``redacted`` the text with kinds in their place."""
    schema = f"doc_id long, base {_SPANS.format('')}, spans {_SPANS.format(', score: double')}" + ", redacted string" * redacted
    return docs.select("doc_id", "text").mapInArrow(_detect(train(docs), redacted), schema)
