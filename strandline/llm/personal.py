"""Personal data: base matches by format, and more by a boosted classifier of candidates.

Four kinds of spans, in this order: e-mail addresses, IP addresses, payment cards, phone
numbers. Base matches are those of fixed patterns and always stay. Beside them generators
propose spans freely, overlapping ones too: parts of longer runs of digits, numbers
without a plus, addresses with written-out or bracketed signs. Boosted trees judge every
candidate by its format and its surroundings, and a threshold per kind, set on rows that
the trees haven't seen, decides which are added.

No table says where personal data are. The trees learn from windows of the corpus itself
into which made-up items are planted, so it is known which candidate is right: items of
every kind in forms that the base patterns miss, and look-alikes such as dates, versions
and order numbers.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_small_batches

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Windows that the classifier learns from, and code points of each.
SAMPLE_WINDOWS, WINDOW = 4000, 400
#: Share of what a threshold lets through that must be right on rows not learned from.
PRECISION = 0.98
ROUNDS, DEPTH, BINS, RATE, SHRINK = 60, 3, 24, 0.2, 1.0

Span = tuple[int, int, int]  # kind, start, end

#: What the patterns of numbers match lies within one of these; none is shorter than seven.
_NUMERIC = re.compile(r"[0-9][0-9 ()./+-]*+")
# Starting only where no digit stands before changes no match and keeps long runs linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _octets(groups: Iterable[str]) -> bool:
    """Whether every group is at most 255, however many zeros lead it."""
    return all(len(g := d.lstrip("0")) <= 3 and int(g or 0) <= 255 for d in groups)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def numeric(text: str) -> list[tuple[int, int]]:
    """Where digits and the signs between them stand, if there are seven or more."""
    return [m.span() for m in _NUMERIC.finditer(text) if m.end() - m.start() >= 7]


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base matches by kind and start, and matches of the patterns that failed their check."""
    good: list[Span] = [(EMAIL, *s) for s in _emails(text)]
    failed: list[Span] = []
    areas = numeric(text)
    for m in (m for a in areas for m in _IP.finditer(text, *a)):
        (good if _octets(m[0].split(".")) else failed).append((IP, *m.span()))
    for m in (m for s, e in areas if e - s >= 16 for m in _CARD.finditer(text, s, e)):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) >= 16:
            (good if len(digits) <= 19 and luhn(digits) else failed).append((CARD, *m.span()))
    for m in _PHONE.finditer(text):
        (good if 8 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15 else failed).append((PHONE, *m.span()))
    return good, failed


# --- candidates ---------------------------------------------------------------------------------------------------

_RUN = re.compile(r"(?<![0-9])[0-9]++(?:[ ().\-/]{1,3}[0-9]++)*+")
_QUAD = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\)| dot )[0-9]{1,3}){3}(?![0-9])")
_V6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_AT = re.compile(r" ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?| @ | (?:at|AT) (?=[\w-]{1,63} (?:dot|DOT) )")
_SIGNS, _BRACKETED = (" @ ", " dot ", " DOT "), re.compile(r"[\[({<] ?(?:at|AT|@)")
_BEFORE_AT = re.compile(r"[\w.%+-]{1,64}\Z")
_AFTER_AT = re.compile(r"[\w-]{1,63}(?:(?:\.| ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| (?:dot|DOT) )[\w-]{1,63})+")
#: Words that stand before items of each kind, and before numbers that are none.
HINTS = (
    re.compile(r"(?i)mail|contact|write"), re.compile(r"(?i)\bip\b|address|host|server|adresse"),
    re.compile(r"(?i)card|visa|credit|karte|carte|tarjeta|amex"), re.compile(r"(?i)tel|phone|call|fax|mobil|tél|llam"),
)
OTHERWISE = re.compile(r"(?i)isbn|order|version|date|invoice|\bref|\bid\b|token|build|serial|\$|€|#|%")
_BEFORE, _AROUND = 24, 40


def candidates(text: str) -> Iterator[tuple[Span, int, int]]:
    """Proposed spans, overlapping ones too, and how many groups of digits go on before and after."""
    for m in _AT.finditer(text) if any(s in text for s in _SIGNS) or _BRACKETED.search(text) else ():
        before = _BEFORE_AT.search(text, max(0, m.start() - 64), m.start())
        after = _AFTER_AT.match(text, m.end())
        if before and after:
            yield (EMAIL, before.start(), after.end()), 0, 0
    for pattern, signs, n in ((_QUAD, (".]", ".)", ".}", "dot"), 3), (_V6, (":",), 7)):
        if sum(map(text.count, signs)) >= n:
            for m in pattern.finditer(text):
                yield (IP, *m.span()), 0, 0
    for m in (m for a in numeric(text) for m in _RUN.finditer(text, *a) if m.end() - m.start() >= 7):
        groups = [g.span() for g in _DIGITS.finditer(text, *m.span())]
        for i, (start, _) in enumerate(groups):
            total = 0
            for j in range(i, len(groups)):
                total += groups[j][1] - groups[j][0]
                if total > 19:
                    break
                end, left, right = groups[j][1], i, len(groups) - 1 - j
                if j - i == 3 and (left or right) and text.count(".", start, end) == 3 == end - start - total:
                    yield (IP, start, end), left, right
                if total >= 13:
                    yield (CARD, start, end), left, right
                if 7 <= total <= 15:
                    yield (PHONE, _widened(text, start), end), left, right


def _widened(text: str, start: int) -> int:
    """Where a number begins with the bracket and the plus before it."""
    if start and text[start - 1] == "(":
        start -= 1
    return start - (start > 0 and text[start - 1] == "+")


def _side(text: str, at: int) -> int:
    if not 0 <= at < len(text) or text[at].isspace():
        return 0
    return 1 if text[at].isalpha() else 2 if text[at].isdigit() else 3


FEATURES = (
    "kind", "digits", "groups", "longest", "shortest", "last", "plus", "brackets", "signs", "widest_gap", "luhn", "octets", "leading_zeros", "fours", "three_four",
    "letters", "length", "top_label", "written_out", "non_ascii", "before", "after", "goes_on_before", "goes_on_after", "hint", "otherwise", "failed_base", "first_digit", "distinct", "digits_around",
)


class Places:
    """Spans that don't overlap, to be asked whether another touches one of them."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()):
        self.spans = sorted(spans)

    def touch(self, start: int, end: int) -> bool:
        k = bisect_right(self.spans, start, key=lambda s: s[1])
        return k < len(self.spans) and self.spans[k][0] < end

    def add(self, start: int, end: int) -> None:
        insort(self.spans, (start, end))


def by_kind(spans: list[Span]) -> list[Places]:
    return [Places(s[1:] for s in spans if s[0] == kind) for kind in range(len(KINDS))]


def features(text: str, span: Span, left: int, right: int, failed: list[Places]) -> list[float]:
    """Format and surroundings of a candidate, in the order of FEATURES."""
    kind, start, end = span
    item = text[start:end]
    groups = _DIGITS.findall(item)
    digits, sizes = "".join(groups), [len(g) for g in groups]
    gaps = [g for g in re.split(r"[0-9]+", item)[1:-1]]
    before, around = text[max(0, start - _BEFORE):start], text[max(0, start - _AROUND):end + _AROUND]
    tail = re.search(r"[^\W\d_]+\Z", item)
    return [
        kind, len(digits), len(groups), max(sizes, default=0), min(sizes, default=0), sizes[-1] if sizes else 0, item.startswith("+"), "(" in item, len(set(gaps)), max(map(len, gaps), default=0),
        bool(digits) and luhn(digits), _octets(groups), any(len(g) > 1 and g[0] == "0" for g in groups), bool(sizes) and sizes == [4] * (len(sizes) - 1) + sizes[-1:] and len(sizes) > 2, sizes[-2:] == [3, 4],
        sum(map(str.isalpha, item)), end - start, len(tail[0]) if tail else 0, bool(re.search(r"(?i)[\[({<]| dot ", item)), not item.isascii(), _side(text, start - 1), _side(text, end), left, right,
        bool(HINTS[kind].search(before)), bool(OTHERWISE.search(before)), failed[kind].touch(start, end), int(digits[0]) if digits else -1, len(set(digits)),
        sum(map(str.isdigit, around)) - len(digits),
    ]


# --- boosted trees ------------------------------------------------------------------------------------------------


@dataclass
class Trees:
    """Complete binary trees of DEPTH: a node sends rows whose ``feature`` is above ``cut`` to the right."""

    start: float = 0.0
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 2**DEPTH - 1), int))
    cut: np.ndarray = field(default_factory=lambda: np.zeros((0, 2**DEPTH - 1)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 2**DEPTH)))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (2**DEPTH - 1)]
        return out


def boosted(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for logistic loss, grown by second-order gain over binned features."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    n_bins = max(len(c) for c in cuts) + 1
    rate = y.mean()
    trees = Trees(math.log(rate / (1 - rate)))
    margin = np.full(len(x), trees.start)
    grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, np.inf)
        node = np.zeros(len(x), int)
        for k in range(2**DEPTH - 1):
            mine = np.flatnonzero(node == k)
            if len(mine):
                sums = np.stack([[np.bincount(bins[mine, f], w[mine], n_bins) for w in (g, h)] for f in range(x.shape[1])])
                left = sums.cumsum(axis=2)
                total = left[:, :, -1:]
                right = total - left
                gain = left[:, 0] ** 2 / (left[:, 1] + SHRINK) + right[:, 0] ** 2 / (right[:, 1] + SHRINK) - total[:, 0] ** 2 / (total[:, 1] + SHRINK)
                for f, c in enumerate(cuts):
                    gain[f, len(c):] = 0
                f, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[f, b] > 1e-6:
                    feature[k], cut[k] = f, cuts[f][b]
            node[mine] = 2 * k + 1 + (x[mine, feature[k]] > cut[k])
        node -= 2**DEPTH - 1
        leaf = -RATE * np.bincount(node, g, 2**DEPTH) / (np.bincount(node, h, 2**DEPTH) + SHRINK)
        margin += leaf[node]
        grown.append((feature, cut, leaf))
    trees.feature, trees.cut, trees.leaf = (np.stack(part) for part in zip(*grown))
    return trees


@dataclass
class Model:
    """Trees, the line that turns their margins into chances, and the least chance per kind (None: none are added)."""

    trees: Trees = field(default_factory=Trees)
    slope: float = 1.0
    shift: float = 0.0
    least: tuple[float | None, ...] = (None,) * len(KINDS)

    def chances(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.trees.margin(x) + self.shift, -500, 500)))


# --- learning ------------------------------------------------------------------------------------------------------

_NAMES = "anna ben chloe david elena farid greta hugo ines jonas kim lena marc nora omar paula quentin rosa sami tara".split()
_TOPS = "com org net de fr es io info".split()


def _some_digits(draw: random.Random, n: int) -> str:
    return "".join(draw.choice("0123456789") for _ in range(n))


def _number(draw: random.Random, n: int, valid: bool) -> str:
    """Digits that pass the card check, or fail it."""
    head = draw.choice("3456") + _some_digits(draw, n - 2)
    right = next(c for c in "0123456789" if luhn(head + c))
    return head + (right if valid else str((int(right) + draw.randint(1, 9)) % 10))


def _grouped(digits: str, sizes: Iterable[int], sign: str) -> str:
    parts, at = [], 0
    for n in sizes:
        parts.append(digits[at:at + n])
        at += n
    return sign.join(parts)


def _address(draw: random.Random) -> str:
    name, host, top = draw.choice(_NAMES) + draw.choice(["", ".", "_"]) + _some_digits(draw, draw.randint(0, 3)), draw.choice(_NAMES), draw.choice(_TOPS)
    left, right = draw.choice(["[]", "()", "{}", "<>"])
    return draw.choice([
        f"{name} {left}at{right} {host} {left}dot{right} {top}", f"{name}{left}at{right}{host}.{top}", f"{name}{left}@{right}{host}.{top}", f"{name} at {host} dot {top}", f"{name} @ {host}.{top}",
    ])


def _net(draw: random.Random) -> str:
    parts = [str(draw.randint(1, 255)) for _ in range(4)]
    return draw.choice(["[.]".join(parts), "(.)".join(parts), "[dot]".join(parts), ":".join(f"{draw.randint(0, 65535):x}" for _ in range(8))])


def _call(draw: random.Random) -> str:
    d = _some_digits(draw, 10)
    return draw.choice([f"({d[:3]}) {d[3:6]}-{d[6:]}", _grouped(d, (3, 3, 4), "-"), _grouped(d, (3, 3, 4), "."), _grouped(d, (3, 3, 4), " "), f"0{d[:3]}/{d[3:10]}", f"00{d[:2]} {d[2:4]} {d[4:]}"])


def _pay(draw: random.Random) -> str:
    if draw.random() < 0.4:
        return _grouped(_number(draw, 15, True), (4, 6, 5), draw.choice([" ", "-"]))
    return _grouped(_number(draw, 16, True), (4, 4, 4, 4), draw.choice([".", "/"]))


def _lookalike(draw: random.Random) -> str:
    """Something that isn't personal but proposes candidates."""
    d = _some_digits
    return draw.choice([
        lambda: f"20{d(draw, 2)}-{draw.randint(1, 12):02}-{draw.randint(1, 28):02} {draw.randint(0, 23):02}:{d(draw, 2)}", lambda: f"{draw.randint(1, 28):02}.{draw.randint(1, 12):02}.20{d(draw, 2)}",
        lambda: ".".join(str(draw.randint(0, 40)) for _ in range(draw.randint(5, 7))), lambda: f"978-{d(draw, 1)}-{d(draw, 4)}-{d(draw, 4)}-{d(draw, 1)}", lambda: _number(draw, draw.randint(13, 19), False),
        lambda: _grouped(_number(draw, 16, False), (4, 4, 4, 4), draw.choice(" -./")), lambda: _number(draw, draw.randint(13, 15), draw.random() < 0.3), lambda: d(draw, draw.randint(7, 12)), lambda: f"{d(draw, 2)}.{d(draw, 4)} {d(draw, 1)}.{d(draw, 5)}",
        lambda: " ".join(d(draw, draw.randint(1, 4)) for _ in range(draw.randint(3, 9))), lambda: f"{d(draw, 4)}-{d(draw, 4)}", lambda: f"{draw.choice(_NAMES)} at the {draw.choice(_NAMES)}", lambda: f"({d(draw, 3)}) {d(draw, 4)}", lambda: hashlib.sha1(d(draw, 9).encode()).hexdigest(),
        lambda: f"{draw.choice(_NAMES)} [at] {draw.choice(_NAMES)}", lambda: ".".join(str(draw.randint(256, 999)) for _ in range(4)), lambda: f"{d(draw, 3)}/{d(draw, 5)}-{d(draw, 2)}",
    ])()


_SAYS = {EMAIL: ["mail", "contact:", "E-Mail:"], IP: ["IP", "host", "server"], CARD: ["card", "Visa:", "Karte"], PHONE: ["tel", "phone:", "call", "Tel."]}
_SAYS_OTHERWISE = ["order", "version", "ISBN", "ref.", "id", "date:", "build", "total"]


def _item(draw: random.Random) -> tuple[str, list[Span]]:
    """Something made up with the word before it, and the spans that are personal in it."""
    kind = draw.choice([EMAIL, IP, CARD, PHONE, None, None, None])
    spans: list[Span] = []
    if kind is None:
        said, item = draw.choice([*_SAYS_OTHERWISE, "", "", draw.choice(_SAYS[draw.randrange(4)])]), _lookalike(draw)
    else:
        said = draw.choice([*_SAYS[kind], ""])
        joined = draw.random() < 0.4
        if kind == CARD and joined:  # two that run into each other
            item, spans = f"{_number(draw, 16, True)} {_number(draw, 16, True)}", [(CARD, 0, 16), (CARD, 17, 33)]
        elif kind == PHONE and joined:  # one that runs into another number
            d = _some_digits(draw, 10)
            own = f"+{draw.randint(1, 99)} ({d[:3]}) {d[3:6]}-{d[6:]}"
            item, spans = f"{own} {draw.choice([_some_digits(draw, draw.randint(4, 9)), '.'.join(str(draw.randint(1, 255)) for _ in range(4))])}", [(PHONE, 0, len(own))]
        else:
            item = {EMAIL: _address, IP: _net, CARD: _pay, PHONE: _call}[kind](draw)
            spans = [(kind, 0, len(item))]
    head = f"{said} " if said else ""
    return head + item, [(k, s + len(head), e + len(head)) for k, s, e in spans]


def planted(text: str, draw: random.Random) -> tuple[str, list[Span]]:
    """A text with one to four things made up in it, some of them close, and the spans that are personal among those."""
    places = [m.start() for m in re.finditer(r" (?=\S)", text)] or [0]
    at = draw.randrange(len(places))
    out, done, spans = "", 0, []
    for _ in range(draw.choice([1, 1, 2, 3, 4])):
        item, own = _item(draw)
        head = f"{text[done:places[at]]}{draw.choice(['', '', ',', ' and'])} " if out else f"{text[:places[at]]} "
        spans += [(k, s + len(out) + len(head), e + len(out) + len(head)) for k, s, e in own]
        out, done = out + head + item, places[at]
        at = min(len(places) - 1, at + draw.choice([0, 1, 1, 2, 9]))
    return out + text[done:], spans


def examples(windows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and window numbers of the candidates in windows with planted items."""
    x, y, of = [], [], []
    for k, window in enumerate(windows):
        text, right = planted(window, random.Random(hashlib.sha256(f"{k}:{window}".encode()).digest()))
        good, failed = map(by_kind, base_spans(text))
        for span, left, after in candidates(text):
            # what a base match covers is decided already
            if not any(p.touch(*span[1:]) for p in good):
                x.append(features(text, span, left, after, failed))
                y.append(span in right)
                of.append(k)
    return np.array(x, float).reshape(-1, len(FEATURES)), np.array(y, float), np.array(of, int)


def learn(windows: list[str]) -> Model:
    """A model from windows of text: two thirds grow the trees, the rest sets the chances and thresholds."""
    x, y, of = examples(windows)
    held = of % 3 == 2
    if not 0 < y[~held].sum() < (~held).sum() or not 0 < y[held].sum() < held.sum():
        return Model()
    model = Model(boosted(x[~held], y[~held]))
    margin, truth = model.trees.margin(x[held]), y[held]
    line = np.stack([margin, np.ones(len(margin))])
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(w @ line, -30, 30)))
        w = w - np.linalg.solve((line * (p * (1 - p))) @ line.T + np.eye(2), line @ (p - truth) + w - [1.0, 0.0])
    model.slope, model.shift = w
    chance = model.chances(x[held])
    least: list[float | None] = []
    for kind in range(len(KINDS)):
        own = x[held][:, 0] == kind
        order = np.argsort(-chance[own], kind="stable")
        c, right = chance[own][order], truth[own][order].cumsum()
        # only after the last of equal chances can a threshold stand
        ends = np.flatnonzero(np.append(c[1:] < c[:-1], True)) if len(c) else np.array([], int)
        good = [k for k in ends if right[k] >= PRECISION * (k + 1) and c[k] >= 0.5]
        # halfway to the next chance, which would let too much through
        least.append(float((c[good[-1]] + max(0.5, c[good[-1] + 1] if good[-1] + 1 < len(c) else 0.5)) / 2) if good else None)
    model.least = tuple(least)
    return model


def fit(docs: DataFrame, windows: int = SAMPLE_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from at most ``windows`` windows of WINDOW code points, one of each of the rows with the smallest hashes.

    Windows that repeat count once. Without text there is nothing to learn and no span is added.
    """
    text = F.col(f"`{text_col}`")
    order = F.xxhash64(F.col(f"`{id_col}`"), text)
    begin = F.pmod(order, F.greatest(F.length(text) - WINDOW, F.lit(0)) + 1) + 1
    some = docs.where(F.length(text) > 0).select(order.alias("h"), F.substring(text, begin.cast("int"), F.lit(WINDOW)).alias("w"))
    # hashes are even, so a bound on them leaves about twice as many windows as are taken, however many tasks there are
    share = 2 * windows / max(1, docs.count())
    if share < 1:
        some = some.where(F.col("h") < int((share - 0.5) * 2**64))
    first = some.groupBy("h").agg(F.min("w").alias("w"))
    return learn(sorted({r["w"] for r in first.orderBy("h").limit(windows).collect()}))


# --- use -----------------------------------------------------------------------------------------------------------


def found_in(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text, by kind and start; candidates of all texts are judged together."""
    out, asked, x = [], [], []
    for k, text in enumerate(texts):
        good, failed = base_spans(text)
        out.append((good, list(good)))
        covered, missed = by_kind(good), by_kind(failed)
        for span, left, right in candidates(text):
            if model.least[span[0]] is not None and not any(p.touch(*span[1:]) for p in covered):
                asked.append((k, span))
                x.append(features(text, span, left, right, missed))
    if asked:
        chance = model.chances(np.array(x, float))
        taken = [Places() for _ in texts]
        best = sorted((-c, s[1] - s[2], k, s) for c, (k, s) in zip(chance, asked) if c >= model.least[s[0]])
        for _, _, k, span in best:
            if not taken[k].touch(*span[1:]):
                taken[k].add(*span[1:])
                out[k][1].append(span)
    return [(good, sorted(both)) for good, both in out]


def written(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def spans_table(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base matches by kind, the digest of the base spans, and all spans of every row.

    Spans are ``kind:start:end`` by kind, then start, in code points, end exclusive. Null
    and empty texts have none. Row by row, so repeated rows are all returned and an empty
    table gives no rows; other columns are ignored.
    """
    in_small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                found = found_in([t or "" for t in part.column(1).to_pylist()], model)
                counts = [pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in range(len(KINDS))]
                digests = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digests, pa.array([written(both) for _, both in found], pa.string())], ["id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"])

    fields = [*(T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *fields])
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, model: Model, text_col: str = "text", mark: str = "[{}]") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one. Null stays null."""

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for text in texts.to_pylist():
            if text:
                parts, done = [], 0
                for start, end, kind in sorted((s, e, k) for k, s, e in found_in([text], model)[0][1]):
                    if start >= done:
                        parts += [text[done:start], mark.format(KINDS[kind])]
                    done = max(done, end)
                text = "".join(parts) + text[done:]
            out.append(text)
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, clean(docs[f"`{text_col}`"]))
