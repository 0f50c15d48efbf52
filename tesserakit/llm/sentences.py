"""Sentence boundaries across languages and scripts.

Abbreviations, collocations across a period and frequent sentence starters are learned unsupervised,
per language, by log-likelihood ratios over all texts (after Kiss and Strunk, 2006), and with them
how words are written inside sentences. Each period is then classified by these statistics. Texts are
first cut into blocks at blank lines and list marks; quotes and brackets that close again keep what
they hold together; scripts without spaces or without end marks have their own rules.

The languages of a script are told apart by words that are learned as well: those that texts labelled
with a language have more often than others have, by the same ratio, from a bounded sample of labelled
texts. Labels only train; each block's language is told from its own words, so wrong ones do no harm.

Counting is a map-side aggregation followed by one shuffle of the counts; words and pairs are scored
there. The model, sent to every task, has what was accepted, and of the words common inside sentences
all that stand somewhere behind an abbreviation, a single letter or an ellipsis, where they decide; of the
rest, which decide nothing in these texts, those of relative frequency LEAST or more.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spark_util import cut_lineage

#: Common words of this relative frequency are in a model wherever they stand, so that it serves other texts as well.
LEAST = 1e-5
#: Texts whose labels the words of languages are learned from, about, and words of a language.
SAMPLE, PROFILE = 20_000, 150
#: Stands for a token that ends in an ellipsis, among the pairs.
ELLIPSIS = "…"
#: Stands before a word that begins small, among the sentence starters.
SMALL = "~"
#: Languages whose script has no capitals.
CASELESS = {"ar", "hi", "ja", "ko", "th", "zh"}
#: Counts are brought down to a corpus of this many words, for the scores don't keep their meaning on larger ones.
REFERENCE = 1_000_000
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0

# Function words by which languages are told apart where no texts are labelled.
COMMON = {
    "en": "the of and to in is it that for was with as on at by this from are be not no when",
    "de": "der die das und ist nicht ein eine den dem mit von zu auf für im wird des sich wenn",
    "fr": "le la les et est un une des du de en que qui dans pour pas au sur ce il y a aux par plus mais avec",
    "es": "el la los las y es un una de que en por para con no si del al se su lo como más pero cuando",
}
COMMON = {lang: frozenset(text.split()) for lang, text in COMMON.items()}
COMMON = {lang: own - frozenset().union(*(o for other, o in COMMON.items() if other != lang)) for lang, own in COMMON.items()}
SCRIPTS = [
    ("ja", regex.compile(r"[\p{Hiragana}\p{Katakana}]")),
    ("ko", regex.compile(r"\p{Hangul}")),
    ("zh", regex.compile(r"\p{Han}")),
    ("th", regex.compile(r"[\p{Thai}\p{Lao}]")),
    ("hi", regex.compile(r"\p{Devanagari}")),
    ("ar", regex.compile(r"\p{Arabic}")),
    ("el", regex.compile(r"\p{Greek}")),
    ("ru", regex.compile(r"\p{Cyrillic}")),
]
LATIN = regex.compile(r"\p{Latin}+")
_PLANE = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))
#: The number of each UTF-16 unit's script: 1 for Latin, then as in SCRIPTS.
SCRIPT_OF = np.zeros(0x10000, dtype=np.uint8)
for _k, _pattern in enumerate([LATIN, *(p for _, p in SCRIPTS)], 1):
    SCRIPT_OF[[ord(c) for c in "".join(_pattern.findall(_PLANE))]] = _k
#: From Greek on: a stretch without any of these is in Latin letters.
BEYOND = re.compile(r"[\u0370-\u1dff\u2e80-\ud7ff\uf900-\ufdff\ufe70-\ufeff\uff66-\uffdc\U00010000-\U0003ffff]")

WIDE_ENDS = "。！？｡"
ENDS = ".!?…؟।॥。！？｡"
PAIRS = {"(": ")", "[": "]", "“": "”", "„": "“", "«": "»", "‘": "’", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "‹": "›"}
CLOSERS = ")]}\"'”“’»」』）】》›"
OPENERS = "([{\"'“„«‘¿¡「『（【《‹"
QUOTES = "\"'”“’»」』›"
BLANKS = " \t\n\r"
MARK = re.compile(r"[.!?…؟।॥。！？｡;;]+")
BULLET = re.compile(r"[ \t]*(?:[-*•‣◦▪·–]|(\d{1,4})[.)])[ \t]+(?=\S)")
NO_MARKS = re.compile(r"[\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0edf]")
WORD = re.compile(r"\S+")
PAIRED = re.compile("[" + re.escape("".join(PAIRS) + "".join(PAIRS.values()) + "\"'") + "]")
ENDING, OPENING = frozenset(".!?…؟।॥:" + CLOSERS), frozenset(OPENERS)

COUNTS = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("lang", "a", "b")] + [T.StructField(c, T.LongType()) for c in ("period", "plain", "lower", "inside", "n")]
)


def language(text: str, profiles: dict[str, frozenset[str]] = COMMON) -> str:
    """The language of a stretch: by script, and among those in Latin letters by their words; 'xx' if nothing tells.

    ``profiles`` has each language's words; where none is found, the first language in it counts.
    """
    if not text.isascii() and BEYOND.search(text):
        units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype=np.uint16)
        _, latin, *found = np.bincount(SCRIPT_OF[units], minlength=len(SCRIPTS) + 2).tolist()
        counts = {lang: n for (lang, _), n in zip(SCRIPTS, found)}
        if counts["ja"] and counts["ja"] * 8 >= counts["zh"]:
            counts["ja"] += counts["zh"]
        best = max(counts, key=lambda k: counts[k])
        if counts[best] * (3 if best in ("ja", "zh", "ko", "th") else 1) > latin:
            return best
        if not latin:
            return "xx"
    words = set(text.lower().split())
    best, most = next(iter(profiles), "xx"), 0
    for lang, common in profiles.items():
        if (n := len(words & common)) > most:
            best, most = lang, n
    return best


def label(lang: str | Column) -> Column:
    """A language's name from a label: in lower case, without what follows a hyphen or underscore."""
    return F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]{2,8})(?:[-_].*)?$", 1)


def core(token: str) -> str:
    """A token without opening marks in front and closing marks, commas and the like behind; final periods stay."""
    return token.strip(OPENERS + "-–—*").rstrip(CLOSERS + ",;:!?…—–")


@lru_cache(maxsize=200_000)
def kind(token: str) -> tuple[str, bool, str]:
    """A token's type (lower case, '#' for anything with a digit), whether a period ends it, and its first letter's case (U, L or ?)."""
    inner = core(token)
    period = inner.endswith(".") and not inner.endswith("..")
    name = inner.rstrip(".")
    if not name:
        return "", False, "?"
    first = name[0]
    if any(c.isdigit() for c in name):
        return "#", period, "?"
    case = "U" if first.isupper() else "L" if first.islower() else "?"
    if case == "L" and "." in name and len(name) > 4 and max(map(len, name.split("."))) > 2:
        case = "?"  # a file's or host's name
    return name.lower(), period, case


@dataclass
class Block:
    """A stretch of a text that sentences don't reach across: where it begins and ends, and whether it is a list item."""

    start: int
    end: int
    item: bool = False


def blocks(text: str) -> list[Block]:
    """Paragraphs, headings and list items. Blank lines end a block; a list goes on from item to item."""
    out: list[Block] = []
    at, open_, listing, number = 0, None, False, 0
    for line in text.split("\n"):
        end = at + len(line)
        if not line.strip(BLANKS):
            open_, listing = None, False
        else:
            first = line.lstrip(" \t")[0]
            mark = BULLET.match(line) if first in "-*•‣◦▪·–" or first.isdigit() else None
            if mark and (open_ is None or listing):
                if mark.group(1):
                    n = int(mark.group(1))
                    fits = n == number + 1 if listing else n <= 1
                else:
                    n, fits = 0, True
            else:
                fits = False
            if fits:
                open_, listing, number = Block(at + mark.end(), end, True), True, n
                out.append(open_)
            elif open_ is None:
                open_ = Block(at, end)
                out.append(open_)
            else:
                open_.end = end
        at = end + 1
    return out


@dataclass
class Model:
    """What was learned for one language."""

    abbreviations: set[str] = field(default_factory=set)
    collocations: set[tuple[str, str]] = field(default_factory=set)
    starters: set[str] = field(default_factory=set)
    #: Words written small inside sentences and never with a capital there.
    common: set[str] = field(default_factory=set)


class Models(dict[str, Model]):
    """Models by language, and the words by which languages in Latin letters are told apart."""

    def __init__(self, profiles: dict[str, frozenset[str]] | None = None):
        super().__init__()
        self.profiles = profiles or COMMON


def _period_ends(before: str, after: str, model: Model) -> bool:
    """Whether the sentence ends after a token that ends in a period."""
    name, _, _ = kind(before)
    following, another, case = kind(after)
    known = name in model.abbreviations or len(name) == 1 and name.isalpha()
    if case == "L":
        return not known and SMALL + following in model.starters
    if (name, following) in model.collocations:
        return False
    if len(name) == 1 and len(following) == 1 and another:
        return False  # a name's initials
    if known:
        return case == "U" and (following in model.starters or following in model.common)
    return True


def _closed(text: str, start: int, end: int) -> dict[int, int]:
    """Opening marks that close again within the stretch, and where."""
    stack: list[tuple[str, int]] = []
    out: dict[int, int] = {}
    for m in PAIRED.finditer(text, start, end):
        i, c = m.start(), m.group()
        for depth in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
            if stack[depth][0] == c:
                if c == "'" and (text[i - 1].isalnum() and i + 1 < end and text[i + 1].isalnum()):
                    break
                out[stack[depth][1]] = i
                del stack[depth:]
                break
        else:
            if c in PAIRS:
                stack.append((PAIRS[c], i))
            elif c in "\"'" and (i == start or not text[i - 1].isalnum()) and i + 1 < end and not text[i + 1].isspace():
                stack.append((c, i))
    return out


def _no_mark_units(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Cuts of a stretch at spaces between letters of scripts without end marks."""
    out, at = [], start
    for i in range(start + 1, end - 1):
        if text[i] not in BLANKS:
            continue
        if text[i] == "\n":
            if NO_MARKS.match(text[at:i].rstrip()[-1:] or " ") or NO_MARKS.search(text[at:i]):
                out.append((at, i))
                at = i
            continue
        left, right = text[i - 1], text[i + 1]
        letters = NO_MARKS.match(left), NO_MARKS.match(right)
        if (letters[0] and (letters[1] or right in OPENERS)) or (letters[1] and left in OPENERS):
            out.append((at, i))
            at = i
    out.append((at, end))
    return out


def _sentences(text: str, start: int, end: int, model: Model, lang: str) -> list[tuple[int, int]]:
    out, at = [], start
    closed = _closed(text, start, end)
    spans, closing = sorted(closed.items()), set(closed.values())
    k = 0
    skip_to = start
    greek = lang == "el"
    for m in MARK.finditer(text, start, end):
        i, j = m.start(), m.end()
        if i < skip_to:
            continue
        run = m.group()
        if (";" in run or ";" in run) and not greek:
            continue
        # which closed quote or bracket the mark is in, outermost first
        while k < len(spans) and spans[k][1] < i:
            k += 1
        outer = None
        for n in range(k, len(spans)):
            a, b = spans[n]
            if a > i:
                break
            if b >= i and a >= at:
                outer = (a, b)
                break
        wide = run[-1] in WIDE_ENDS
        q = j
        while q < end:
            if text[q] in CLOSERS and not (text[q] == "“" and q not in closing):
                q += 1
            elif text[q] in "  " and q + 1 < end and text[q + 1] == "»" and outer is not None:
                q += 2
            else:
                break
        if outer is not None and outer[1] >= q:
            continue  # inside what closes later
        quoted = outer is not None and text[outer[1]] in QUOTES and outer[1] >= j
        lead = text[at : outer[0]].strip() if quoted else None
        if q >= end:
            continue
        if wide:
            if quoted and not (lead and lead[-1] in "：:，,"):
                continue
            stop = True
        else:
            if text[q] not in BLANKS:
                if run.strip("…") and not run.startswith("..") and _runs_on(text, at, i, q, end, model):
                    out.append((at, q))
                    at = skip_to = q
                continue
            n = q
            while n < end and text[n] in BLANKS:
                n += 1
            if n >= end:
                continue
            after = WORD.match(text, n, end).group()
            following, _, case = kind(after)
            if after[0] in "—–,;:-" and not after[1:2].isalnum() and after[0] != "-" or after in ("-", "—", "–"):
                continue
            if case == "?" and following not in ("", "#") and quoted and not lead and (unicodedata.category(following[0]) in ("Lo", "Lm")):
                continue  # no case tells, and the sentence so far is but the quotation
            if set(run) <= {"."} and len(run) == 1:
                b = i
                while b > at and text[b - 1] not in BLANKS:
                    b -= 1
                stop = _period_ends(text[b:j], after, model)
            elif run.strip(".…") == "":
                stop = case == "U" and (following in model.starters or following in model.common)
            else:
                stop = case != "L" or SMALL + following in model.starters
        if stop:
            out.append((at, q))
            at = q
            skip_to = q
    out.append((at, end))
    return out


def _runs_on(text: str, at: int, mark: int, q: int, end: int, model: Model) -> bool:
    """Whether a sentence begins right behind an end mark, the blank between being lost."""
    b = mark
    while b > at and text[b - 1].isalpha():
        b -= 1
    word = text[b:mark]
    if len(word) < 2 or b > at and text[b - 1] not in BLANKS + OPENERS + CLOSERS:
        return False
    n = q
    while n < end and (text[n].isalnum() or text[n] == "-"):
        n += 1
    after = text[q:n]
    if not after or not after[0].isalpha() or n < end and text[n] in "@_/" or n + 1 < end and text[n] == "." and text[n + 1].islower():
        return False
    if after[0].isupper():
        return word[-1].islower() and (after[1:2].islower() or len(after) == 1) or not word[-1].isupper() and not word[-1].islower()
    if after[0].islower():
        return SMALL + after in model.starters and word.lower() not in model.abbreviations
    return not word[-1].isupper() and not word[-1].islower() and unicodedata.category(after[0]) == "Lo" and word not in model.abbreviations


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    return start, end


def sentences(text: str, models: dict[str, Model]) -> list[tuple[int, int]]:
    """start and end of the sentences of a text, in order."""
    out = []
    profiles = getattr(models, "profiles", COMMON)
    for block in blocks(text):
        start, end = _trim(text, block.start, block.end)
        if start >= end:
            continue
        if block.item:
            out.append((start, end))
            continue
        lang = language(text[start:end], profiles)
        model = models.get(lang) or models.get("xx") or Model()
        parts = _no_mark_units(text, start, end) if lang != "en" and NO_MARKS.search(text, start, end) else [(start, end)]
        for a, b in parts:
            a, b = _trim(text, a, b)
            out += [_trim(text, x, y) for x, y in _sentences(text, a, b, model, lang)]
    return [(a, b) for a, b in out if a < b]


def _count(profiles: dict[str, frozenset[str]]):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every: dict[str, Counter] = defaultdict(Counter)
        opening: dict[str, Counter] = defaultdict(Counter)
        final: dict[str, Counter] = defaultdict(Counter)
        pairs: dict[str, Counter] = defaultdict(Counter)

        def flush() -> pd.DataFrame:
            rows: dict[tuple, list[int]] = defaultdict(lambda: [0, 0, 0, 0, 0])
            for lang, counts in every.items():
                for token, n in counts.items():
                    name, period, case = kind(token)
                    if not name:
                        continue
                    row = rows[lang, name, ""]
                    # a quotation's end is no abbreviation's period
                    row[0 if period and token[-1] not in QUOTES else 1] += n
                    row[4] += final[lang][token] if period else 0
                    inside = 0 if token[0] in OPENING else n - opening[lang][token]
                    row[2] += n if case == "L" else 0
                    row[3] += inside if case == "U" else 0
            for lang, counts in pairs.items():
                for (a, b), n in counts.items():
                    x, period, _ = kind(a)
                    y, _, case = kind(b)
                    if x and y and period:
                        rows[lang, x, (SMALL if case == "L" else "") + y][4] += n
                    elif y and case == "U" and core(a).endswith((ELLIPSIS, "..")):
                        rows[lang, ELLIPSIS, y][4] += n
            every.clear(), opening.clear(), final.clear(), pairs.clear()
            return pd.DataFrame([(*key, *row) for key, row in rows.items()], columns=COUNTS.fieldNames())

        size = 0
        for part in parts:
            for text in part["text"]:
                for block in blocks(text):
                    stretch = text[block.start : block.end]
                    tokens = stretch.split()
                    if not tokens:
                        continue
                    lang = language(stretch, profiles)
                    every[lang].update(tokens)
                    final[lang][tokens[-1]] += 1
                    ended = [i for i, t in enumerate(tokens) if t[-1] in ENDING]
                    if ended and ended[-1] == len(tokens) - 1:
                        ended.pop()
                    opening[lang].update([tokens[0], *(tokens[i + 1] for i in ended)])
                    pairs[lang].update((tokens[i], tokens[i + 1]) for i in ended if "." in tokens[i] or ELLIPSIS in tokens[i])
            size += sum(map(len, part["text"]))
            if size > 20_000_000:
                yield flush()
                size = 0
        yield flush()

    return run


def _ratio(n_a: Column, n_b: Column, n_ab: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio that b follows a more often than it otherwise does."""

    def like(k: Column, m: Column, p: Column) -> Column:
        p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.log(p) + (m - k) * F.log(1 - p)

    p, p1 = n_b / n, n_ab / n_a
    p2 = F.greatest((n_b - n_ab) / F.greatest(n - n_a, F.lit(1e-9)), F.lit(0.0))
    return -2 * (like(n_ab, n_a, p) + like(n_b - n_ab, n - n_a, p) - like(n_ab, n_a, p1) - like(n_b - n_ab, n - n_a, p2))


def _abbreviation(name: Column, period: Column, plain: Column, n_periods: Column, n: Column) -> Column:
    """Kiss and Strunk's score: how much a period belongs to the word, weighted for short words with periods that seldom lack one."""
    p1, p2 = n_periods / n, 0.99
    ratio = -2 * (period * F.log(p1) + plain * F.log(1 - p1) - period * math.log(p2) - plain * math.log(1 - p2))
    inner = F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) + 1
    letters = F.length(name) - inner + 1
    return ratio * F.exp(-letters) * inner * F.pow(letters.cast("double"), -F.least(plain, F.lit(300.0)))


def _label_words(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per label, the number of blocks ('' as word), of those in Latin letters (' ') and of those that have each word."""
    counts: Counter = Counter()
    for part in parts:
        for name, text in zip(part["label"], part["text"]):
            for block in blocks(text):
                stretch = text[block.start : block.end]
                counts[name, ""] += 1
                if not BEYOND.search(stretch):
                    counts[name, " "] += 1
                    counts.update((name, w) for w in set(stretch.lower().split()) if w.isalpha())
    yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["label", "word", "n"])


def learn_profiles(texts: DataFrame, lang: str, text: str = "text") -> dict[str, frozenset[str]]:
    """The words by which the labelled languages in Latin letters are told apart, the commonest language first; none without labels.

    They are learned from about SAMPLE labelled texts, drawn by a hash: of each language the PROFILE words of the greatest
    likelihood ratio to stand in its texts' blocks rather than in others'.
    """
    rows = texts.select(label(lang).alias("label"), F.col(text).alias("text"), F.xxhash64(text).alias("h")).filter("label <> '' and length(text) > 0")
    n = texts.count()
    if n > SAMPLE:
        rows = rows.filter(F.pmod("h", F.lit(1_000_000)) < int(1e6 * SAMPLE / n))
    counts = cut_lineage(rows.mapInPandas(_label_words, "label string, word string, n long").groupBy("label", "word").agg(F.sum("n").alias("n")))
    of = counts.groupBy("label").agg(*(F.coalesce(F.max(F.when(F.col("word") == w, F.col("n"))), F.lit(0)).alias(c) for c, w in (("every", ""), ("latin", " "))))
    sizes = {r["label"]: r["latin"] for r in of.filter("latin >= 20 and 2 * latin >= every").collect()}  # one row a label
    if len(sizes) < 2:
        return {}
    spark = texts.sparkSession
    known = F.broadcast(spark.createDataFrame([*sizes.items()], "label string, n_a long"))
    own = counts.filter("word not in ('', ' ')").join(known, "label")
    all_ = own.groupBy("word").agg(F.sum("n").alias("n_b"))
    scored = own.filter("n >= 3").join(all_, "word").withColumn("all", F.lit(float(sum(sizes.values()))))
    n_a, n_b, n_ab, total = (F.col(c).cast("double") for c in ("n_a", "n_b", "n", "all"))
    scored = scored.filter(n_ab / n_a > n_b / total).withColumn("score", _ratio(n_a, n_b, n_ab, total))
    best = scored.withColumn("r", F.row_number().over(W.partitionBy("label").orderBy(F.desc("score"), "word"))).filter(F.col("r") <= PROFILE)
    words: dict[str, set[str]] = {name: set() for name in sorted(sizes, key=lambda k: (-sizes[k], k))}
    for name, word in best.select("label", "word").collect():
        words[name].add(word)
    return {name: frozenset(own) for name, own in words.items()}


def learn(texts: DataFrame, text: str = "text", lang: str | None = None) -> Models:
    """Models of all languages in ``texts``, from all of their rows; ``lang`` names a column of labels, if there is one.

    Words and pairs are scored where they are counted, starters over all pairs across a period; only accepted abbreviations,
    starters and collocations come to the driver, and of the common words those that decide something or are frequent.
    """
    models = Models(learn_profiles(texts, lang, text) if lang else None)
    rows = texts.select(F.col(text).alias("text")).filter(F.length("text") > 0)
    counts = rows.mapInPandas(_count(models.profiles), COUNTS).groupBy("lang", "a", "b").agg(*(F.sum(c).alias(c) for c in ("period", "plain", "lower", "inside", "n")))
    counts = cut_lineage(counts)
    every = F.col("period") + F.col("plain")
    totals = counts.filter("b = ''").groupBy("lang").agg(F.sum(every).alias("all"), F.sum("period").alias("periods"), F.sum("n").alias("closing"))
    totals = totals.filter("all >= 20 and periods >= 2").toPandas()  # one row a language
    models.update((name, Model()) for name in totals["lang"])
    if not models:
        return models
    spark = texts.sparkSession
    totals["scale"] = np.minimum(1.0, REFERENCE / totals["all"])
    known = F.broadcast(spark.createDataFrame(totals, "lang string, all bigint, periods bigint, closing bigint, scale double"))
    scale, n_all = F.col("scale"), F.col("all") * F.col("scale")

    words = counts.filter("b = ''").drop("b").join(known, "lang")
    score = _abbreviation(F.col("a"), F.col("period") * scale, F.col("plain") * scale, F.col("periods") * scale, n_all)
    # without capitals, a word that ends blocks as often as any is a sentence's last
    last = F.col("lang").isin(*CASELESS) & (F.col("n") / F.greatest(F.col("period"), F.lit(1)) > F.greatest(F.lit(0.05), 0.5 * F.col("closing") / F.col("periods")))
    short = (F.col("a") != "#") & (F.col("period") > 0) & (every >= 2) & F.col("a").rlike(r"\p{L}") & (score >= ABBREVIATION) & ~last
    for lang_, a in words.filter(F.coalesce(short, F.lit(False))).select("lang", "a").collect():
        models[lang_].abbreviations.add(a)

    accepted = spark.createDataFrame([(lang_, a) for lang_, m in models.items() for a in m.abbreviations], "lang string, a string")
    pairs = counts.filter("b <> ''").select("lang", "a", "b", "n").join(known, "lang").join(F.broadcast(accepted.withColumn("short", F.lit(True))), ["lang", "a"], "left")
    pairs = pairs.withColumn("following", F.regexp_replace("b", f"^{SMALL}", ""))
    count = counts.filter("b = ''").select("lang", F.col("a").alias("following"), every.alias("count"))
    unsure = pairs.filter(F.col("short").isNotNull() | F.col("a").rlike(r"^\p{L}$") | (F.col("a") == ELLIPSIS)).select("lang", F.col("following").alias("a")).distinct()
    common = words.filter((F.col("lower") > 0) & (F.col("inside") <= 0.1 * F.col("lower")) & (every >= 2))
    decisive = common.join(unsure.withColumn("decides", F.lit(True)), ["lang", "a"], "left").filter(F.col("decides") | (every >= F.col("all") * LEAST))
    for lang_, a in decisive.select("lang", "a").collect():
        models[lang_].common.add(a)
    pairs = pairs.filter(F.col("a") != ELLIPSIS)
    open_ = F.col("short").isNull() & ~F.col("a").rlike(r"^\p{L}$") & (F.col("a") != "#")
    starts = pairs.filter(open_).groupBy("lang", "b", "following", "all", "scale").agg(F.sum("n").alias("n"))
    breaks = starts.groupBy("lang").agg(F.sum("n").alias("breaks"))  # one row a language
    starts = starts.filter("b <> '#'").join(F.broadcast(breaks), "lang").join(count, ["lang", "following"], "left")
    n, n_b = F.col("n"), F.greatest(F.col("count"), F.col("n"))
    starts = starts.filter((n / F.col("breaks") > n_b / F.col("all")) & (_ratio(F.col("breaks") * scale, n_b * scale, n * scale, n_all) >= STARTER))
    for lang_, b in starts.select("lang", "b").collect():
        models[lang_].starters.add(b)

    # with a number in front, or a word that no abbreviation is, the pair must hold most of the other's cases
    special = pairs.filter((F.col("n") >= 2) & (F.col("short").isNotNull() | (F.col("a") == "#") | (F.col("following") == "#")))
    starters = spark.createDataFrame([(lang_, b) for lang_, m in models.items() for b in m.starters], "lang string, following string")
    special = special.join(F.broadcast(starters), ["lang", "following"], "left_anti")
    special = special.join(count, ["lang", "following"], "left").join(counts.filter("b = ''").select("lang", "a", F.col("period").alias("ended")), ["lang", "a"], "left")
    n_a = F.greatest(F.col("ended"), F.col("n"))
    most = F.when(F.col("following") == "#", n > 0.5 * n_a).otherwise(n > 0.5 * n_b)
    special = special.filter((n / n_a > n_b / F.col("all")) & most & (_ratio(n_a * scale, n_b * scale, n * scale, n_all) >= COLLOCATION))
    for lang_, a, b in special.select("lang", "a", "following").collect():
        models[lang_].collocations.add((a, b))
    return models


def _split(models: dict[str, Model]):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [sentences(text, models) for text in part["text"]]
            counts = np.array([len(f) for f in found], dtype=np.int64)
            spans = np.array([x for f in found for s in f for x in s], dtype=np.int64).reshape(-1, 2)
            number = np.arange(len(spans)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pd.DataFrame(
                {"doc_id": part["doc_id"].repeat(counts).to_numpy(), "sentence_no": number.astype(np.int32), "start_char": spans[:, 0], "end_char": spans[:, 1]}
            )

    return run


def split_sentences(texts: DataFrame, key: str = "doc_id", text: str = "text", models: dict[str, Model] | None = None, lang: str | None = None) -> DataFrame:
    """doc_id, sentence_no (from 0), start_char and end_char of every sentence, heading and list item.

    Places are code points, ends exclusive; list marks and outer blanks are left out. Models are learned from ``texts``
    themselves unless given. Null, empty and blank texts have no sentences; a null key stays null; rows that occur twice
    count once; extra columns play no part. ``lang`` names a column of labels that languages are learned from; a text's own
    label isn't used for it, since it can be wrong, and nulls and labels that name no language are none.
    """
    models = learn(texts, text, lang) if models is None else models
    rows = texts.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.length("text") > 0)
    return rows.mapInPandas(_split(models), "doc_id long, sentence_no int, start_char long, end_char long").distinct()
