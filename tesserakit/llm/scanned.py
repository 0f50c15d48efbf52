"""Repairing the text of scanned pages.

The lines of a file are a sequence that a linear conditional model labels by layout: page header,
footer, first line of a paragraph, further line, break. It is trained here, without labelled pages, on
the plain cases of a bounded sample of files, which layout rules label (``seeds``). Words are
then judged against a vocabulary counted over all texts that weren't scanned, and paragraphs are put
together from the lines' labels, with broken words joined and misread ones corrected.

Counting words is a map-side aggregation and one shuffle of counts. Every task gets the words of
relative frequency LEAST or more, at most 1/LEAST of them. What a file asks about beyond these, words
it has and words that its odd ones may be misreadings of, is looked up among all counted words by joins
(``_answers``) and goes to that file alone. So a word counts as known however rare it is.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spark_util import cut_lineage

#: Files the layout model is trained on, about; twice as many at most.
SAMPLE = 400
#: Further rounds of training on the model's own labels; they made running lines of plain text, so none is the default.
ROUNDS = 0
#: Least relative frequency of a word in the vocabulary that every task has.
LEAST = 1e-6
#: Files of up to so many characters are drawn for training.
TRAINING = 200_000

PAGE = re.compile(r"^\s*\[PAGE\s+(\d+)\]\s*$")
CODE = re.compile(r"^[A-Z]{1,3}[-–][0-9lIOoSBZ]{1,5}$")
TERMINAL = (".", "!", "?", ":", "”", "“", '"', "»", ")", "…")
HYPHENS = "-‐¬­"
WORD = regex.compile(r"[\p{L}\p{M}]+(?:[-‐’'][\p{L}\p{M}]+)*")
#: A word that no digits or codes run into.
WHOLE = regex.compile(r"(?<![\w-])[\p{L}\p{M}]+(?:[-‐’'][\p{L}\p{M}]+)*(?!\w|-\d)")
PUNCTUATION = ".,;:!?()[]{}\"“”„«»‘’'…–—"
# Characters that scans mistake for a digit.
DIGITS = str.maketrans({"l": "1", "I": "1", "|": "1", "i": "1", "O": "0", "o": "0", "S": "5", "B": "8", "Z": "2", "z": "2", "]": "1", "g": "9", "b": "6"})
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
NUMBER = re.compile(r"^\W*(?:(?:[Pp]age|[Pp]|[Ss]eite|[Ss]|[Pp]ág|[Pp]g|[Bb]latt|[Ff]olio)\b\.?\s*)?([0-9lIOoSBZzgb|]{1,5})(?:\s*(?:of|von|de|sur|/)\s*[0-9lIOoSBZzgb|]{1,5})?\W*$")

STATES = ["header", "footer", "first", "further", "break"]
HEADER, FOOTER, FIRST, FURTHER, BREAK = range(5)
# Character groups that scans mistake for one another.
CONFUSED = "rn:m cl:d ri:n li:h ii:u vv:w nn:m ci:a ti:h lc:k fi:ﬁ fl:ﬂ in:m tl:d lt:h"
CONFUSED = [tuple(p.split(":")) for p in CONFUSED.split()]


@dataclass
class Line:
    """A line with its layout features."""

    text: str
    page: int
    kind: str  # page, blank or text
    edge: str = "M"
    shape: str = "up"
    repeat: str = "0"
    width: str = "full"
    gap: str = "00"
    before: str = "o"
    after: str = "full"
    ends: bool = False
    value: int | None = None

    def features(self) -> tuple[str, ...]:
        return (
            f"{self.edge} {self.shape} {self.repeat}",
            f"{self.edge[0]} {self.shape}",
            f"{self.shape} {self.repeat} {self.ends}",
            f"{self.width} {self.edge[0] == 'M'}",
            f"gap {self.gap[0]} {self.before} {self.shape == 'low'}",
            f"gap {self.gap[1]} {self.edge}",
            f"after {self.after}",
        )


def page_number(text: str) -> int | None:
    """The number a line consists of, in the forms page numbers have; None if it is none."""
    t = text.strip()
    if re.fullmatch(r"[ivxlc]{1,6}", t) and t not in ("l", "ll", "lll"):
        total = 0
        for a, b in zip(t, t[1:] + " "):
            total += -ROMAN[a] if b in ROMAN and ROMAN[b] > ROMAN[a] else ROMAN[a]
        return total
    m = NUMBER.match(t)
    if not m or not any(c.isdigit() for c in m.group(1)) and len(m.group(1)) > 3:
        return None
    figures = m.group(1)
    if t[0] in "[|" and figures[-1] in "|l1I" and not t.endswith(("]", ")")) and len(figures) > 1:
        figures = figures[:-1]  # a closing bracket, misread
    digits = figures.translate(DIGITS)
    return int(digits) if digits.isdigit() else None


def _key(text: str) -> str:
    """What of a line stays the same from page to page: its letters and codes, not its numbers, blanks or case."""
    return "".join(c for c in text.lower() if c.isalpha())


def _alike(a: str, b: str) -> bool:
    if a == b:
        return True
    if not a or not b or abs(len(a) - len(b)) > 3 or min(len(a), len(b)) < 6:
        return False
    bits = sum(x == y for x, y in zip(a, b)), sum(x == y for x, y in zip(a[::-1], b[::-1]))
    return sum(bits) >= 0.85 * max(len(a), len(b))


def _shape(text: str) -> tuple[str, int | None]:
    t = text.strip()
    value = page_number(t)
    if value is not None:
        return "num", value
    words = t.split()
    coded = [w for w in words if CODE.match(w.strip("|·"))]
    ends = re.match(r"^([0-9lIO|]{1,4})\s{2,}|.*?(?:\s{2,}|·\s*)([0-9lIO|]{1,4})$", t)
    number = next((g for g in ends.groups() if g), None) if ends else None
    number = number.translate(DIGITS) if number else None
    value = int(number) if number and number.isdigit() else None
    if len(words) >= 5 and sum(len(w) == 1 for w in words) > 0.7 * len(words):
        return "spaced", None
    if len(words) >= 2 and t.upper() == t and any(c.isalpha() for c in t):
        return "caps", value
    if coded and len(words) <= 11 and not t.endswith((".", ",", ";", "!", "?")) and not t[0].islower():
        rest = [w for w in words if w not in coded and w.strip("|·").isalpha()]
        if len(rest) <= 3 * len(coded) + 2:
            return "code", value
    if value is not None and len(words) <= 4:
        return "row", value
    return ("low" if t[0].islower() else "up"), None


def layout(text: str, title: str | None = None) -> list[Line]:
    """The lines of a file with their features."""
    lines, page = [], 0
    for raw in text.split("\n"):
        raw = raw.rstrip("\r")
        m = PAGE.match(raw)
        if m:
            page += 1
        lines.append(Line(raw, page, "page" if m else "text" if raw.strip() else "blank"))
    pages: dict[int, list[int]] = defaultdict(list)
    for k, line in enumerate(lines):
        if line.kind == "text":
            pages[line.page].append(k)
    keys: dict[int, list[tuple[int, str]]] = {}
    widths = sorted(len(line.text) for line in lines if line.kind == "text")
    usual = widths[int(len(widths) * 0.75)] if widths else 1
    for p, ks in pages.items():
        n = len(ks)
        for r, k in enumerate(ks):
            line = lines[k]
            line.edge = "T1" if r == 0 else "B1" if r == n - 1 else "T2" if r == 1 else "B2" if r == n - 2 else "M"
            line.shape, line.value = _shape(line.text)
            w = len(line.text.strip()) / usual
            line.ends = line.text.rstrip().endswith(TERMINAL) and line.shape in ("up", "low")
            line.width = "full" if w >= 0.85 else "mid" if w >= 0.6 else "short"
            blank = lambda i: i < 0 or i >= len(lines) or lines[i].kind != "text"
            line.gap = f"{int(blank(k - 1))}{int(blank(k + 1))}"
        keys[p] = [(k, _key(lines[k].text)) for k in {*ks[:2], *ks[-2:]}]
    named = _key(title or "")
    times = Counter(key for own in keys.values() for key in {key for _, key in own})
    frequent = [key for key, n in times.items() if n > 1 and len(key) >= 6]
    for p, own in keys.items():
        for k, key in own:
            if len(key) >= 6:
                # the same on other pages, or nearly so where it was misread
                n = times[key] - 1
                if n < 2:
                    n += sum(any(key != other and _alike(key, other) for _, other in keys.get(q, ())) for q in (p - 2, p - 1, p + 1, p + 2))
                if n < 2:
                    n += max((times[other] for other in frequent if other != key and _alike(key, other)), default=0)
                n = max(n, 2 if named and _alike(key, named) else 0)
                lines[k].repeat = "0" if not n else "1" if n == 1 else "2"
    offsets = Counter(line.value - line.page for line in lines if line.value is not None and line.edge != "M" and line.shape != "row")
    best = offsets.most_common(1)[0] if offsets else (None, 0)
    ended, width = "e", "short"
    for line in lines:
        if line.kind == "page":
            continue
        if line.kind == "text":
            if line.value is not None and line.value - line.page == best[0] and (best[1] > 1 or best[0] == 0) and line.edge != "M":
                line.shape += "fit"
            line.before, line.after = ended, f"{ended} {width}"
            t = line.text.rstrip()
            if line.shape in ("up", "low", "row"):
                width = line.width
                ended = "-" if t[-1:] in HYPHENS else "e" if t.endswith(TERMINAL) else "o"
    return lines


def _seed(line: Line, running: bool) -> int:
    """A line's state where layout makes it plain. ``running``: the line next to it on the page's side is no text."""
    if line.kind != "text":
        return BREAK
    odd = line.shape in ("num", "numfit", "code", "codefit", "spaced", "caps", "rowfit") or line.repeat != "0" and line.shape not in ("low", "row")
    if line.shape == "num" and line.edge != "M" and line.value is not None and line.value > 999:
        odd = False
    if odd and (line.edge == "T1" or line.edge == "T2" and running):
        return HEADER
    if odd and (line.edge == "B1" or line.edge == "B2" and running):
        return FOOTER
    if line.shape != "low" and (line.gap[0] == "1" and line.before == "e" or line.after in ("e short", "e mid")):
        return FIRST
    return FURTHER


def seeds(lines: list[Line]) -> list[int]:
    """States of all lines by ``_seed``: from the top of each page down, and for its last lines from the bottom up."""
    out = [_seed(line, False) for line in lines]
    for order, edge, state in ((range(len(lines)), "T2", HEADER), (range(len(lines) - 1, -1, -1), "B2", FOOTER)):
        last = BREAK
        for k in order:
            if lines[k].kind == "text":
                if lines[k].edge == edge and last == state:
                    out[k] = _seed(lines[k], True)
                last = out[k]
    return out


@dataclass
class Layout:
    """A linear conditional model over a file's lines: weights of features and of moves from state to state.

    The score of a labelling is the sum of its lines' feature weights and its moves' weights; the best labelling is found by
    Viterbi's algorithm. Feature weights are those of a softmax fitted by gradient steps, moves' weights the log ratio of
    how often a move is made and how often chance would make it.
    """

    moves: np.ndarray
    weights: dict[str, np.ndarray]

    @staticmethod
    def fit(files: list[list[Line]], labels: list[list[int]], steps: int = 1000, rate: float = 10.0, decay: float = 1e-6) -> Layout:
        n = len(STATES)
        names: dict[str, int] = {}
        seen: dict[tuple[str, ...], np.ndarray] = defaultdict(lambda: np.zeros(n))  # lines of equal features count together
        counts = np.full((n + 1, n), 0.5)
        for lines, own in zip(files, labels):
            last = n
            for line, s in zip(lines, own):
                counts[last, s] += 1
                last = s
                if line.kind == "text":
                    seen[line.features()][s] += 1
        at = np.array([[names.setdefault(v, len(names)) for v in row] for row in seen], dtype=np.int64)
        weights = np.zeros((len(names), n))
        if len(at):
            target = np.array(list(seen.values()))
            size = target.sum(axis=1, keepdims=True)
            for _ in range(steps):
                score = weights[at].sum(axis=1)
                score -= score.max(axis=1, keepdims=True)
                p = np.exp(score)
                p /= p.sum(axis=1, keepdims=True)
                slope = np.zeros_like(weights)
                np.add.at(slope, at, ((target - p * size) / size.sum())[:, None, :])
                weights += rate * (slope - decay * weights)
        share = counts.sum(axis=0) / counts.sum()
        moves = np.log(counts / counts.sum(axis=1, keepdims=True)) - np.log(share)
        return Layout(np.clip(moves, -1, 1), {v: weights[k] for v, k in names.items()})

    def label(self, lines: list[Line]) -> list[int]:
        """The best states."""
        n = len(STATES)
        score = np.zeros((len(lines), n))
        came = np.zeros((len(lines), n), dtype=np.int64)
        for i, line in enumerate(lines):
            if line.kind != "text":
                seen = np.full(n, -1e9)
                seen[BREAK] = 0.0
            else:
                seen = np.zeros(n)
                for v in line.features():
                    if (w := self.weights.get(v)) is not None:
                        seen = seen + w
                seen[BREAK] = -1e9
                if line.shape in ("up", "low") and line.repeat == "0":
                    seen[[HEADER, FOOTER]] -= 3.0  # plain text that no other page has at its edge
                if line.edge[0] != "T":
                    seen[HEADER] = -1e9
                if line.edge[0] != "B" and line.edge != "T1":
                    seen[FOOTER] = -1e9
            if i == 0:
                score[0] = self.moves[n] + seen
                continue
            paths = score[i - 1][:, None] + self.moves[:n]
            came[i] = paths.argmax(axis=0)
            score[i] = paths.max(axis=0) + seen
        out = [int(score[-1].argmax())]
        for i in range(len(lines) - 1, 0, -1):
            out.append(int(came[i][out[-1]]))
        return out[::-1]


def train(texts: list[tuple[str, str | None]], rounds: int = ROUNDS) -> Layout:
    """A layout model from files' texts and titles, trained on their seeds and, for ``rounds``, on its own labels."""
    files = [layout(text, title) for text, title in texts]
    model = Layout.fit(files, [seeds(lines) for lines in files])
    for _ in range(rounds):
        model = Layout.fit(files, [model.label(lines) for lines in files])
    return model


@dataclass
class Vocabulary:
    """Words of texts that weren't scanned, in lower case, with their counts, and names as they were written."""

    counts: dict[str, int]
    known: dict[str, str | None] = field(default_factory=dict)
    #: Hyphenated words by what stands before their last hyphen.
    compounds: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.compounds:
            self.compounds = _compounds(self.counts, {})

    def __contains__(self, word: str) -> bool:
        return word in self.counts

    def _near(self, word: str) -> set[str]:
        letters = "abcdefghijklmnopqrstuvwxyzäöüßáéíóúñàèêçâîôûëï"
        out = set()
        for i in range(len(word) + 1):
            a, b = word[:i], word[i:]
            if b:
                out.add(a + b[1:])
                out.update(a + c + b[1:] for c in letters)
            out.update(a + c + b for c in letters)
        return out & self.counts.keys()

    def _confused(self, word: str) -> set[str]:
        out = set()
        for x, y in CONFUSED:
            for old, new in ((x, y), (y, x)):
                at = word.find(old)
                while at >= 0:
                    out.add(word[:at] + new + word[at + len(old) :])
                    at = word.find(old, at + 1)
        return out

    def correct(self, word: str) -> str | None:
        """The likeliest word that ``word`` is a misreading of, None if there is none; ``word`` is in lower case and not known."""
        if word not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[word] = self._correct(word)
        return self.known[word]

    def _correct(self, word: str) -> str | None:
        if len(word) < 2 or len(word) > 40:
            return None
        once = self._confused(word)
        found = {w for w in once if w in self.counts} or (self._near(word) if len(word) > 3 else set())
        if not found and len(word) > 5:
            found = {w for o in once for w in self._near(o)} | {w for o in once for w in self._confused(o) if w in self.counts}
        return max(found, key=lambda w: (self.counts[w], w)) if found else None

    def parts(self, word: str) -> tuple[str, str] | None:
        """Two known words that ``word`` is made of without a blank."""
        best = None
        for i in range(1, len(word)):
            a, b = word[:i], word[i:]
            if a in self.counts and b in self.counts and (i > 1 or a in ("a", "i", "y", "o", "à")) and (len(b) > 1 or b in ("a", "y", "o")):
                n = min(self.counts[a], self.counts[b])
                if best is None or n > best[0]:
                    best = n, (a, b)
        return best[1] if best else None


    def asking(self) -> Asking:
        return Asking(self.counts, self.known, self.compounds)

    @contextmanager
    def knowing(self, more: dict[str, int]) -> Iterator[Vocabulary]:
        """This vocabulary with further words, for a while."""
        before = self.known, self.compounds
        self.counts.update(more)
        if more:
            self.known, self.compounds = {}, {**self.compounds, **_compounds(more, self.compounds)}
        try:
            yield self
        finally:
            self.known, self.compounds = before
            for word in more:
                del self.counts[word]


def _compounds(words: Iterable[str], known: dict[str, list[str]]) -> dict[str, list[str]]:
    """Last parts of hyphenated words by what stands before, those known included."""
    out: dict[str, list[str]] = {}
    for word in words:
        if "-" in word:
            before, _, last = word.rpartition("-")
            out.setdefault(before, list(known.get(before, ()))).append(last)
    return out


@dataclass
class Asking(Vocabulary):
    """A vocabulary that notes what it was asked and doesn't have."""

    #: Words that may be known, that may be misreadings of known ones, that may be two known ones.
    asked: set[str] = field(default_factory=set)
    unsure: set[str] = field(default_factory=set)
    split: set[str] = field(default_factory=set)

    def __contains__(self, word: str) -> bool:
        if word in self.counts:
            return True
        self.asked.add(word)
        return False

    def correct(self, word: str) -> str | None:
        if word not in self.counts:
            self.unsure.add(word)
        return super().correct(word)

    def parts(self, word: str) -> tuple[str, str] | None:
        self.split.add(word)
        return super().parts(word)


FIGURE = re.compile(r"^[(\[]?[#§$€°]?(?:[-+]?\d[\d.,:/%-]*[a-z%]?|[A-Z]{1,3}-\d+|v?\d+(?:\.\d+)+|[A-Z]{2,}\d*)[)\]]?$")


def _plain(token: str) -> str:
    return token.strip(PUNCTUATION + "*•·|~=<>_/\\")


def odd(token: str, vocabulary: Vocabulary) -> tuple[bool, str | None]:
    """Whether a token is misread, and what it should be (None: not known). Tokens that are but figures or signs aren't."""
    bare = _plain(token)
    if not bare or FIGURE.match(bare) or "@" in bare or "://" in bare:
        return False, None
    if not any(c.isalpha() for c in bare):
        return False, None
    low = bare.lower().replace("‐", "-").replace("­", "")
    if low in vocabulary:
        return False, None
    if re.fullmatch(r"[\w-]+(?:\.[\w-]+)+", bare) and not any(p in vocabulary for p in low.split(".")[1:] if len(p) > 4):
        return False, None  # a file's or host's name
    if any(c.isdigit() for c in bare) or not WORD.fullmatch(bare):
        letters = low.translate(str.maketrans("0156|8!93", "olsblbige"))
        for fixed in (letters, low.translate(str.maketrans("016|58!", "oiblsbi")), low.translate(str.maketrans("01|!", "oltl"))):
            fixed = "".join(c for c in fixed if c.isalpha() or c == "-")
            if fixed in vocabulary:
                return True, fixed
        code = re.match(r"^([A-Z]{2,3})-([\dlIOoSBZzgb|]+)$", bare)
        if code:
            return True, f"{code.group(1)}-{code.group(2).translate(DIGITS)}"
        if re.fullmatch(r"[\dlIOoSBZ|.,]+", bare):
            return True, bare.translate(DIGITS)
        return any(c.isalpha() for c in low) and bool(re.search(r"[^\W\d_]\d[^\W\d_]|^\d[^\W\d_]{2,}|[^\W\d_]{2,}\d$", bare)), None
    if "-" in low:
        pieces = [p for p in low.split("-") if p]
        bad = [p for p in pieces if p not in vocabulary and len(p) > 1]
        if not bad:
            return False, None
        fixed = [p if p in vocabulary else vocabulary.correct(p) or p for p in pieces]
        return True, "-".join(fixed)
    fixed = vocabulary.correct(low)
    if fixed is not None:
        return True, fixed
    parts = vocabulary.parts(low) if len(low) > 3 else None
    if parts:
        return True, " ".join(parts)
    return bare[0].islower() and len(bare) > 1, None


def _match_case(fixed: str, token: str) -> str:
    return fixed[:1].upper() + fixed[1:] if token[:1].isupper() else fixed


@dataclass
class Repaired:
    """A file's lines with labels, the kinds of damage of each line, and its paragraphs."""

    labels: list[int]
    damage: list[set[str]]
    paragraphs: list[str]


def _compound(left: str, right: str, vocabulary: Vocabulary) -> bool:
    """Whether a hyphen between two lines belongs to the word."""
    a, b = _plain(left).lower(), _plain(right).lower()
    if re.fullmatch(r"[A-Z]{1,3}", _plain(left)) and right[:1].isdigit() or left[-1:].isdigit():
        return True
    whole, hyphened = a + b, f"{a}-{b}"
    if any([whole in vocabulary, hyphened in vocabulary]):
        return vocabulary.counts.get(hyphened, 0) > vocabulary.counts.get(whole, 0)
    if vocabulary.correct(b) in vocabulary.compounds.get(a, ()):
        return True
    if vocabulary.correct(whole) is not None:
        return False
    last = a.rsplit("-", 1)[-1]
    return last in vocabulary and b in vocabulary and len(last) > 2 and len(b) > 2


def repair(text: str, title: str | None, model: Layout, vocabulary: Vocabulary) -> Repaired:
    """Labels, damage and paragraphs of one file."""
    lines = layout(text, title)
    labels = model.label(lines)
    damage: list[set[str]] = [set() for _ in lines]
    for k, s in enumerate(labels):
        if s in (HEADER, FOOTER):
            damage[k].add("running")
    body = [k for k, s in enumerate(labels) if s in (FIRST, FURTHER)]
    words = {k: lines[k].text.split() for k in body}
    fixed: dict[int, list[str]] = {k: list(w) for k, w in words.items()}
    skip: set[tuple[int, int]] = set()
    joins: dict[int, str] = {}
    for k, nxt in zip(body, body[1:]):
        last, first = words[k][-1], words[nxt][0]
        if len(last) < 2 or last[-1] not in HYPHENS or not last[-2].isalnum() or not first[0].isalnum():
            continue
        left = last.rstrip(HYPHENS)
        if last[-1] in "-‐" and _compound(left, first, vocabulary):
            joins[k] = left + "-"
            whole = _plain(left + "-" + first)
            if whole.lower() not in vocabulary:
                continue  # each half is judged on its own below
        else:
            damage[k].add("broken")
            joins[k] = left
            whole = _plain(left + first)
            low = whole.lower()
            if low not in vocabulary:
                bad, right = odd(whole, vocabulary)
                if bad:
                    a, b = _plain(left).lower(), _plain(first).lower()
                    if right and right.startswith(a):
                        damage[nxt].add("misread")
                    elif right and right.endswith(b):
                        damage[k].add("misread")
                    elif right:
                        # where the two first differ
                        at = next((i for i, (x, y) in enumerate(zip(low, right)) if x != y), len(low))
                        damage[k if at < len(a) else nxt].add("misread")
                    else:
                        damage[k].add("misread")
        skip |= {(k, len(words[k]) - 1), (nxt, 0)}
    for k in body:
        row = words[k]
        done = -1
        for i, token in enumerate(row):
            if i <= done or (k, i) in skip:
                continue
            bare = _plain(token).lower()
            after = _plain(row[i + 1]).lower() if i + 1 < len(row) and (k, i + 1) not in skip else ""
            joined = bare + after
            torn = after and token[-1:].isalpha() and bare.isalpha() and after.isalpha() and joined in vocabulary
            if torn and (bare not in vocabulary or after not in vocabulary or _unlikely(bare, after, vocabulary)):
                damage[k].add("misread")
                fixed[k][i] = token + row[i + 1]
                fixed[k][i + 1] = ""
                done = i + 1
                continue
            bad, right = odd(token, vocabulary)
            if isinstance(vocabulary, Asking) and after and bare.isalpha() and after.isalpha() and bare in vocabulary.asked and after not in vocabulary:
                vocabulary.correct(joined), vocabulary.correct(after)
            if bad:
                if after and bare.isalpha() and after.isalpha() and after not in vocabulary and (whole := vocabulary.correct(joined)) and vocabulary.correct(after) is None:
                    damage[k].add("misread")
                    fixed[k][i], fixed[k][i + 1], done = _match_case(whole, token), "", i + 1
                    continue
                damage[k].add("misread")
                if right:
                    core = _plain(token)
                    fixed[k][i] = token.replace(core, _match_case(right, core), 1)
    paragraphs: list[str] = []
    held = ""
    for k, nxt in zip(body, [*body[1:], None]):
        if labels[k] == FIRST or not paragraphs:
            paragraphs.append("")
        row = [w for w in fixed[k] if w]
        if k in joins and row:
            row, carry = row[:-1], joins[k]
        else:
            carry = None
        if held and row:
            row[0] = held + row[0]
            held = ""
        piece = " ".join(row)
        paragraphs[-1] = f"{paragraphs[-1]} {piece}".strip()
        held = carry or ""
    if held and paragraphs:
        paragraphs[-1] = f"{paragraphs[-1]} {held}".strip()
    return Repaired(labels, damage, [p for p in paragraphs if p])


def _unlikely(a: str, b: str, vocabulary: Vocabulary) -> bool:
    """Whether two known words more likely are one that was torn apart: one of them is seldom seen by itself."""
    return min(vocabulary.counts[a], vocabulary.counts[b]) < 0.2 * vocabulary.counts[a + b]


def _count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter = Counter()
    for part in parts:
        for text in part["text"]:
            counts.update(text.split())
        if len(counts) > 1_000_000:
            yield _words(counts)
            counts = Counter()
    yield _words(counts)


def _words(tokens: Counter) -> pd.DataFrame:
    counts: Counter = Counter()
    for token, n in tokens.items():
        for w in WHOLE.findall(token.lower().replace("‐", "-")):
            counts[w] += n
            for p in w.split("-")[: None if "-" in w else 0]:
                counts[p] += n
    return pd.DataFrame({"word": pd.Series(list(counts), dtype=object), "n": pd.Series(list(counts.values()), dtype=np.int64)})


@dataclass
class Words:
    """Counts of all words (word, n), how many there are of a word that every task has, and the vocabulary of these."""

    counts: DataFrame
    cut: float
    common: Vocabulary


def vocabulary_of(clean: DataFrame, lexicon: DataFrame | None = None, least: int = 2) -> Words:
    """Words of ``clean`` (column text) from all of its rows, seen ``least`` times or more, and those of ``lexicon`` (column word)."""
    counts = clean.select("text").filter(F.length("text") > 0).mapInPandas(_count, "word string, n long")
    if lexicon is not None:
        known = lexicon.select(F.lower("word").alias("word")).filter("word <> ''").distinct()
        counts = counts.unionByName(known.select("word", F.lit(0).cast("long").alias("n")))
        counts = counts.groupBy("word").agg(F.sum("n").alias("n"), (F.min("n") == 0).alias("listed"))
        counts = counts.select("word", F.when(F.col("listed"), F.greatest("n", F.lit(least))).otherwise(F.col("n")).alias("n"))
    else:
        counts = counts.groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts.filter(F.col("n") >= least))
    total = counts.agg(F.sum("n")).first()[0] or 0
    cut = max(least, total * LEAST)
    return Words(counts, cut, Vocabulary(dict(map(tuple, counts.filter(F.col("n") >= cut).collect()))))


def _ask(model: Layout, vocabulary: Vocabulary):
    """What files ask beyond the common words: a word's place is 'known', 'near' or 'part'."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, text, title in zip(part["source_path"], part["text"], part["title"]):
                asking = vocabulary.asking()
                repair(text, title, model, asking)
                rows += [(path, w, "known") for w in asking.asked] + [(path, w, "near") for w in asking.unsure] + [(path, w, "part") for w in asking.split]
            yield pd.DataFrame(rows, columns=["source_path", "word", "place"])

    return run


def _without_one(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def _question_keys(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keys under which a question meets the words that may answer it: an exact word, or one that an edit leads to."""
    empty = Vocabulary({})
    for part in parts:
        rows = []
        for word, place in zip(part["word"], part["place"]):
            if place == "known":
                rows.append((word, word, True))
            elif place == "part":
                rows += [(word, half, True) for i in range(1, len(word)) for half in (word[:i], word[i:])]
            elif 2 <= len(word) <= 40:
                once = {word, *empty._confused(word)}
                rows += [(word, w, True) for o in once for w in {o, *empty._confused(o)}]
                rows += [(word, k, False) for o in once for k in {o, *_without_one(o)}]
        yield pd.DataFrame(rows, columns=["asked", "key", "exact"])


def _word_keys(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = [(w, n, k, k == w) for w, n in zip(part["word"], part["n"]) for k in {w, *_without_one(w)}]
        yield pd.DataFrame(rows, columns=["word", "n", "key", "whole"])


def _answers(scans: DataFrame, model: Layout, words: Words) -> DataFrame:
    """source_path, text, title and more: what of its questions each file is answered from the words that aren't common.

    Two words are an edit apart only if one of them, or what either becomes without one letter, is the other's as well; so
    both sides' shortened forms are joined, and words that aren't an edit apart but meet do no harm.
    """
    questions = cut_lineage(scans.mapInPandas(_ask(model, words.common), "source_path string, word string, place string").distinct())
    keys = questions.select("word", "place").distinct().mapInPandas(_question_keys, "asked string, key string, exact boolean")
    rare = words.counts.filter(F.col("n") < words.cut)
    exact = keys.filter("exact").join(rare.withColumnRenamed("word", "key"), "key").select("asked", F.col("key").alias("word"), "n")
    close = rare.mapInPandas(_word_keys, "word string, n long, key string, whole boolean")
    close = keys.filter("not exact").join(close, "key").select("asked", "word", "n")
    found = exact.unionByName(close).distinct()
    own = questions.select("source_path", F.col("word").alias("asked")).distinct().join(found, "asked").select("source_path", "word", "n").distinct()
    more = own.groupBy("source_path").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("more"))
    return scans.join(more, "source_path", "left")


def trained(scans: DataFrame) -> Layout:
    """A layout model from about SAMPLE of the files of up to TRAINING characters, drawn by a hash of their paths (all if there are no more)."""
    rows = scans.select("text", "title", F.xxhash64("source_path").alias("h")).filter(F.length("text").between(1, TRAINING)).dropDuplicates(["h"])
    n = rows.count()
    if n > SAMPLE:
        rows = rows.filter(F.pmod("h", F.lit(1_000_000)) < int(1e6 * SAMPLE / n))
    return train([(r["text"], r["title"]) for r in sorted(rows.limit(2 * SAMPLE).collect(), key=lambda r: r["h"])])


def _damage(model: Layout, vocabulary: Vocabulary):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, text, title, more in zip(part["source_path"], part["text"], part["title"], part["more"]):
                with vocabulary.knowing(dict(more or ())):
                    damage = repair(text, title, model, vocabulary).damage
                for k, kinds in enumerate(damage):
                    rows += [(path, k + 1, kind) for kind in sorted(kinds)]
            yield pd.DataFrame(rows, columns=["source_path", "line_no", "kind"])

    return run


def _paragraphs(model: Layout, vocabulary: Vocabulary):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, text, title, more in zip(part["source_path"], part["text"], part["title"], part["more"]):
                with vocabulary.knowing(dict(more or ())):
                    rows += [(path, k, p) for k, p in enumerate(repair(text, title, model, vocabulary).paragraphs)]
            yield pd.DataFrame(rows, columns=["source_path", "paragraph_no", "text"])

    return run


def _scans(scans: DataFrame) -> DataFrame:
    return scans.select("source_path", "text", "title").filter("source_path is not null and length(text) > 0")


def find_damage(scans: DataFrame, clean: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """source_path, line_no (from 1) and kind of damaged lines: running, broken or misread; see ``repair_scans``."""
    scans = _scans(scans)
    model, words = trained(scans), vocabulary_of(clean, lexicon)
    return _answers(scans, model, words).mapInPandas(_damage(model, words.common), "source_path string, line_no long, kind string").distinct()


def repair_scans(scans: DataFrame, clean: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """source_path, paragraph_no (from 0) and text of the paragraphs of scanned files, as once printed.

    ``scans`` has source_path, text and title (title may be null), ``clean`` texts that weren't scanned, from which words
    are learned, ``lexicon`` further words. Null and empty texts give nothing; files that occur twice, word for word, count
    once; extra columns play no part. With no files or no clean texts there is nothing to learn from and the rest still
    holds: an empty table gives no rows, and without words none is called misread by its neighbours.
    """
    scans = _scans(scans)
    model, words = trained(scans), vocabulary_of(clean, lexicon)
    return _answers(scans, model, words).mapInPandas(_paragraphs(model, words.common), "source_path string, paragraph_no int, text string").distinct()
