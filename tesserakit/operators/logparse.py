"""Semi-structured log lines into entries with time, level, component and message.

A deterministic character-level scanner turns a line into tokens (digit runs, letter runs, blanks,
quoted strings, single delimiters). Entry grammars, each a short sequence of elements, then read
the head of the line from those tokens; the first grammar that accepts assigns the fields. A line
no grammar accepts continues the entry before it. One that a grammar accepts may still be part of
the entry before it: lookahead states (``Lookahead``) decide by brackets left open, indentation
around the line and the order of times. Nothing depends on the program that wrote the file: one
file may mix layouts.

One row in, its entries out: the work is a ``mapInPandas`` over the pruned columns and needs no
shuffle, so it scales with the input and no file's entries ever wait for another's.
"""

from __future__ import annotations

import datetime as dt
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names under which programs state a level.
LEVELS = {
    "DEBUG": "DEBUG DBG DEBG TRACE TRC VERBOSE FINE FINER FINEST D V T",
    "INFO": "INFO INF INFORMATION NOTICE NTC NOTE I N",
    "WARN": "WARN WRN WARNING W",
    "ERROR": "ERROR ERR ERRO SEVERE E",
    "FATAL": "FATAL FTL CRITICAL CRIT CRT EMERG EMERGENCY ALERT PANIC F C",
}
LEVEL_OF = {name: level for level, names in LEVELS.items() for name in names.split()}
# Keys under which structured lines carry a field.
TIME_KEYS = {"ts", "time", "timestamp", "@timestamp", "t", "datetime", "date", "asctime", "eventtime"}
LEVEL_KEYS = {"level", "lvl", "severity", "loglevel", "levelname", "log.level", "priority"}
NAME_KEYS = {"component", "logger", "name", "module", "program", "service", "app", "logger_name", "log.logger", "source"}
TEXT_KEYS = {"msg", "message", "event", "text"}
# Names of weekdays and, by number, what syslog calls a severity.
WEEKDAYS = {"mon", "tue", "wed", "thu", "fri", "sat", "sun"}
SEVERITIES = ["FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG"]
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}

DIGIT, ALPHA, BLANK, QUOTE, MARK, END = "digits", "letters", "blank", "quoted", "mark", "end"

SCHEMA = T.StructType(
    [
        T.StructField("source_path", T.StringType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("entry_ts", T.StringType()),
        T.StructField("entry_level", T.StringType()),
        T.StructField("component", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("n_lines", T.LongType()),
    ]
)


class Scanner:
    """Tokens of one line, scanned only as far as a grammar asks.

    States: in a digit run, in a letter run, in blanks, in a quoted string, in its escape. A token
    is ``(kind, text, end)``.
    """

    def __init__(self, line: str):
        self.line, self.tokens, self.at = line, [], 0

    def token(self, k: int) -> tuple[str, str, int]:
        while len(self.tokens) <= k:
            self._scan()
        return self.tokens[k]

    def start(self, k: int) -> int:
        """Where token k begins."""
        return self.token(k - 1)[2] if k else 0

    def _scan(self) -> None:
        line, i = self.line, self.at
        if i >= len(line):
            self.tokens.append((END, "", len(line)))
            return
        c, j = line[i], i + 1
        if "0" <= c <= "9":
            kind = DIGIT
            while j < len(line) and "0" <= line[j] <= "9":
                j += 1
        elif c.isalpha():
            kind = ALPHA
            while j < len(line) and line[j].isalpha():
                j += 1
        elif c in " \t":
            kind = BLANK
            while j < len(line) and line[j] in " \t":
                j += 1
        elif c == '"':
            kind, escaped = QUOTE, False
            while j < len(line) and (escaped or line[j] != '"'):
                escaped = line[j] == "\\" and not escaped
                j += 1
            if j >= len(line):  # an opening quote that nothing closes is a mark
                kind, j = MARK, i + 1
            else:
                j += 1
        else:
            kind = MARK
        self.tokens.append((kind, line[i:j], j))
        self.at = j


def _number(s: Scanner, k: int, *widths: int) -> int | None:
    kind, text, _ = s.token(k)
    return int(text) if kind == DIGIT and len(text) in widths else None


def _mark(s: Scanner, k: int, marks: str) -> bool:
    kind, text, _ = s.token(k)
    return kind == MARK and text in marks


def _clock(s: Scanner, k: int, marks: str = ":") -> tuple[int, int, int, int] | None:
    """hh:mm:ss with an optional fraction: hour, minute, second, next token."""
    h, m, x = _number(s, k, 1, 2), _number(s, k + 2, 2), _number(s, k + 4, 2)
    if h is None or m is None or x is None or not (_mark(s, k + 1, marks) and _mark(s, k + 3, marks)):
        return None
    k += 5
    if _mark(s, k, ".,") and s.token(k + 1)[0] == DIGIT:
        k += 2
    return h, m, x, k


def _half_day(s: Scanner, clock: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    """A clock of twelve hours, if AM or PM follows, as one of twenty-four."""
    h, m, x, k = clock
    half = s.token(k + 1)[1].upper() if s.token(k)[0] == BLANK else ""
    return (h % 12 + 12 * (half == "PM"), m, x, k + 2) if half in ("AM", "PM") and 1 <= h <= 12 else clock


def _zone(s: Scanner, k: int) -> tuple[int, int]:
    """Minutes east of UTC and the next token; no zone is UTC."""
    kind, text, _ = s.token(k)
    if kind == ALPHA and text in ("Z", "z", "UTC", "GMT"):
        return 0, k + 1
    b = k + 1 if kind == BLANK and len(text) == 1 else k
    if b > k and s.token(b)[1] in ("Z", "UTC", "GMT"):
        return 0, b + 1
    if _mark(s, b, "+-"):
        sign = 1 if s.token(b)[1] == "+" else -1
        if (v := _number(s, b + 1, 4)) is not None:
            return sign * (v // 100 * 60 + v % 100), b + 2
        if (h := _number(s, b + 1, 2)) is not None:
            if _mark(s, b + 2, ":") and (m := _number(s, b + 3, 2)) is not None:
                return sign * (h * 60 + m), b + 4
            if s.token(b + 2)[0] in (BLANK, END) or s.token(b + 2)[1] == "]":
                return sign * h * 60, b + 2
    return 0, k


def _moment(y: int, mo: int, d: int, clock: tuple[int, int, int, int], zone: int = 0) -> dt.datetime | None:
    h, m, x, _ = clock
    try:
        at = dt.datetime(y, mo, d, h, m, min(x, 59))
        return at - dt.timedelta(minutes=zone)
    except (ValueError, OverflowError):
        return None


def _month(s: Scanner, k: int) -> int | None:
    kind, text, _ = s.token(k)
    return MONTHS.get(text[:3].lower()) if kind == ALPHA and len(text) >= 3 else None


def read_time(s: Scanner, k: int, year: int) -> tuple[dt.datetime, int, bool] | None:
    """A date with a time of day from token k on: UTC moment, next token, whether the year was missing.

    A date alone is no entry's time. Reads ISO dates, y/m/d, d.m.y, m/d/y (d/m/y where only that is a date) with an
    optional AM or PM, yy/mm/dd, day/month-name/year with a colon, month-name day, weekday month-name day time year,
    packed yyyymmdd-hhmmss and epoch seconds or milliseconds.
    """
    kind, text, _ = s.token(k)
    if kind == DIGIT:
        n = len(text)
        if n == 4 and _mark(s, k + 1, "-/.") and s.token(k + 3)[1] == s.token(k + 1)[1]:
            mo, d = _number(s, k + 2, 1, 2), _number(s, k + 4, 1, 2)
            sep = s.token(k + 5)
            if mo and d and (sep[0] == BLANK or sep[1] in ("T", "t", "_", ",", ":", "-")):
                k2 = k + 6 + (sep[1] == "," and s.token(k + 6)[0] == BLANK)
                if clock := _clock(s, k2):
                    zone, end = _zone(s, clock[3])
                    if at := _moment(int(text), mo, d, clock, zone):
                        return at, end, False
        elif n in (1, 2) and _mark(s, k + 1, ".") and _mark(s, k + 3, "."):
            mo, y = _number(s, k + 2, 1, 2), _number(s, k + 4, 4)
            if mo and y and s.token(k + 5)[0] in (BLANK, MARK) and (clock := _clock(s, k + 6, ":.")):
                zone, end = _zone(s, clock[3])
                if at := _moment(y, mo, int(text), clock, zone):
                    return at, end, False
        elif n in (1, 2) and _mark(s, k + 1, "/") and s.token(k + 2)[0] == DIGIT and _mark(s, k + 3, "/"):
            b, c = _number(s, k + 2, 1, 2), s.token(k + 4)[1]
            if b and c.isdigit() and len(c) in (2, 4) and (s.token(k + 5)[0] == BLANK or _mark(s, k + 5, ",") and s.token(k + 6)[0] == BLANK):
                x = int(text)
                y, mo, d = (2000 + x, b, int(c)) if len(c) == 2 else (int(c), x, b) if x <= 12 else (int(c), b, x)
                if clock := _clock(s, k + 6 + _mark(s, k + 5, ",")):
                    clock = _half_day(s, clock)
                    zone, end = _zone(s, clock[3])
                    if at := _moment(y, mo, d, clock, zone):
                        return at, end, False
        elif n in (1, 2) and (_mark(s, k + 1, "/-") or s.token(k + 1)[0] == BLANK) and (mo := _month(s, k + 2)):
            y = _number(s, k + 4, 4)
            if y and (s.token(k + 5)[0] == BLANK or _mark(s, k + 5, ":T")) and (clock := _clock(s, k + 6)):
                zone, end = _zone(s, clock[3])
                if at := _moment(y, mo, int(text), clock, zone):
                    return at, end, False
        elif n == 8 and (_mark(s, k + 1, "-_") or s.token(k + 1)[1] == "T") and (v := _number(s, k + 2, 6)) is not None:
            clock = (v // 10000, v // 100 % 100, v % 100, k + 3)
            if _mark(s, k + 3, ".,") and s.token(k + 4)[0] == DIGIT:
                clock = (*clock[:3], k + 5)
            zone, end = _zone(s, clock[3])
            if at := _moment(int(text[:4]), int(text[4:6]), int(text[6:]), clock, zone):
                return at, end, False
        elif n in (10, 13) and text[0] in "12":
            if n == 10 and _mark(s, k + 1, ".") and s.token(k + 2)[0] == DIGIT:
                k += 2
            return dt.datetime(1970, 1, 1) + dt.timedelta(seconds=int(text[:10])), k + 1, False
    elif kind == ALPHA and text.lower() in WEEKDAYS and s.token(k + 1)[0] == BLANK and (mo := _month(s, k + 2)):
        d, clock = _number(s, k + 4, 1, 2), _clock(s, k + 6)
        if d and clock and s.token(clock[3])[0] == BLANK and (y := _number(s, clock[3] + 1, 4)):
            if at := _moment(y, mo, d, clock):
                return at, clock[3] + 2, False
    elif kind == ALPHA and (mo := _month(s, k)) and len(text) == 3 and s.token(k + 1)[0] == BLANK:
        d = _number(s, k + 2, 1, 2)
        if d and s.token(k + 3)[0] == BLANK:
            y, k2 = year, k + 4
            if (v := _number(s, k2, 4)) is not None and s.token(k2 + 1)[0] == BLANK:
                y, k2 = v, k2 + 2
            if clock := _clock(s, k2):
                zone, end = _zone(s, clock[3])
                if at := _moment(y, mo, d, clock, zone):
                    return at, end, k2 == k + 4
    return None


def _name(s: Scanner, k: int) -> tuple[str, int] | None:
    """A program's or logger's name: letters, digits and . - _ / $ without blanks, letters first."""
    if s.token(k)[0] != ALPHA and not _mark(s, k, "_"):
        return None
    first, k = s.start(k), k + 1
    while s.token(k)[0] in (ALPHA, DIGIT) or _mark(s, k, "._-/$"):
        k += 1
    text = s.line[first : s.start(k)].rstrip(".-/")
    return text, k


def _level(s: Scanner, k: int) -> tuple[str, int] | None:
    kind, text, _ = s.token(k)
    if kind == ALPHA and len(text) > 1 and (level := LEVEL_OF.get(text.upper())):
        return level, k + 1
    return None


#: Entry grammars, in order of trial. T time, L level, N name, H host, P process or line number, B the letter of a
#: level joined to month and day, C the clock behind it; K a time of day alone, on the file's date; S a syslog priority, which
#: states a level; A anything without blanks or brackets; W a numbered thread's name; D a dotted name; Q a quoted string;
#: "_" one or more blanks; anything else is itself.
GRAMMARS = [
    "< S > P _ T _ A _ N _ A _ A _",
    "< S > P _ T _ A _ A _ A _ A _",
    "< S > T _ H _ N [ P ] :",
    "< S > T _ H _ N :",
    "A _ A _ A _ [ T ] _ Q",
    "[ T ] _ [ N : L ]",
    "T _ [ W ] _ L _ D _ - _",
    "T _ [ W ] _ L _ D :",
    "T _ L _ [ W ] _ D _ - _",
    "T _ L _ [ W ] _ D :",
    "T _ L _ P _ - - - _ [ A ] _ N _ :",
    "T _ L _ P _ - - - _ [ _ A ] _ N _ :",
    "K _ [ A ] _ L _ N _ - _",
    "K _ L _ N _ - _",
    "T _ - _ N _ - _ L _ - _",
    "T _ - _ L _ - _ N _ - _",
    "T _ | _ L _ | _ N _ | _",
    "T | L | N |",
    "T | N | L |",
    "L | N | T |",
    "N | L | T |",
    "L | T | N |",
    "[ T ] _ [ L ] _ [ N ]",
    "[ T ] _ [ N ] _ [ L ]",
    "[ T ] _ [ L ] _ N :",
    "[ T ] _ [ L ]",
    "[ T ] _ N _ L :",
    "[ T ] _ L _ N :",
    "[ T ] _ N . L :",
    "[ T ] _ L :",
    "[ T ]",
    "T _ H _ N [ P ] : _ L :",
    "T _ H _ N [ P ] : _ < L >",
    "T _ H _ N [ P ] :",
    "T _ H _ N : _ L :",
    "T _ L _ [ N ]",
    "T _ [ L ] _ N :",
    "T _ [ L ] _ [ N ]",
    "T _ [ N ] _ L",
    "T _ [ L ]",
    "T _ L _ P _ - - - _ [ N ]",
    "T _ L _ ( N )",
    "T _ ( N ) _ L :",
    "T _ ( N ) _ < L >",
    "T _ ( N )",
    "T _ N _ < L >",
    "T _ < L > _ N :",
    "T _ < L >",
    "T _ N _ L :",
    "T _ N [ P ] : _ L :",
    "T _ N [ P ] _ L :",
    "T _ N [ P ] :",
    "T _ L _ N :",
    "T _ L _ N _ - _",
    "T _ L :",
    "T _ P _ P _ B _ N :",
    "T _ L _",
    "B P _ C _ P _ N : P ]",
    "[ L ] _ T _ N :",
    "[ L ] _ [ T ] _ N :",
    "L _ [ T ] _ N :",
    "L _ T _ N :",
    "L : _ T _ N :",
    "L _ T _ [ N ]",
    "T",
]
GRAMMARS = [g.split() for g in GRAMMARS]


def _run(s: Scanner, k: int) -> tuple[str, int]:
    """What stands without blanks or brackets from token k on, and the next token."""
    first = s.start(k)
    while s.token(k)[0] not in (BLANK, END) and not _mark(s, k, "[]<>"):
        k += 1
    return s.line[first : s.start(k)], k


def _numbered(name: str) -> bool:
    """Whether a name is a thread's of a pool: it ends in a number behind a hyphen."""
    head, hyphen, number = name.rpartition("-")
    return bool(head and hyphen and number.isdigit() and head[0].isalpha())


def _apply(grammar: list[str], s: Scanner, year: int, times: dict, day: tuple[int, int] = (1, 1)) -> tuple[dt.datetime, str, str, int] | None:
    k, at, level, name = 0, None, "", ""
    month_day = 0
    for part in grammar:
        if part == "T":
            if k not in times:
                times[k] = read_time(s, k, year)
            if times[k] is None:
                return None
            at, k, yearless = times[k]
            if "H" in grammar and not yearless and "[" not in grammar and "S" not in grammar:
                return None
        elif part == "K":
            if (clock := _clock(s, k)) is None or (at := _moment(year, *day, clock)) is None:
                return None
            k = clock[3]
        elif part == "S":
            number = _number(s, k, 1, 2, 3)
            if number is None or number > 191:
                return None
            level, k = SEVERITIES[number % 8], k + 1
        elif part in ("A", "W"):
            got = _run(s, k)
            if not got[0] or part == "W" and not _numbered(got[0]):
                return None
            k = got[1]
        elif part == "Q":
            if s.token(k)[0] != QUOTE:
                return None
        elif part == "_":
            if s.token(k)[0] != BLANK:
                return None
            k += 1
        elif part == "L":
            if (got := _level(s, k)) is None:
                return None
            level, k = got
        elif part in ("N", "H", "D"):
            if (got := _name(s, k)) is None or part == "D" and "." not in got[0]:
                return None
            if part != "H":
                name = got[0]
            k = got[1]
        elif part == "P":
            if s.token(k)[0] != DIGIT:
                return None
            month_day, k = int(s.token(k)[1]), k + 1
            if grammar[0] == "B" and grammar[1] == "P" and at is None and not 101 <= month_day <= 1231:
                return None
        elif part == "B":
            kind, text, _ = s.token(k)
            if kind != ALPHA or len(text) != 1 or (level := LEVEL_OF.get(text, "")) == "":
                return None
            k += 1
        elif part == "C":
            if (clock := _clock(s, k)) is None or (at := _moment(year, month_day // 100, month_day % 100, clock)) is None:
                return None
            k = clock[3]
        else:
            if not _mark(s, k, part):
                return None
            k += 1
    if k < 1 or at is None:
        return None
    # what follows must not run on from the head's last token
    if grammar[-1] in ("T", "L") and s.token(k)[0] in (ALPHA, DIGIT):
        return None
    return at, level, name, s.start(k)


def _unquote(text: str) -> str:
    if len(text) < 2 or text[0] != '"':
        return text
    out, i, body = [], 0, text[1:-1]
    while i < len(body):
        c = body[i]
        if c == "\\" and i + 1 < len(body):
            i += 1
            c = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(body[i], body[i])
            if body[i] == "u" and len(h := body[i + 1 : i + 5]) == 4:
                try:
                    c = chr(int(h, 16))
                    i += 4
                except ValueError:
                    pass
        out.append(c)
        i += 1
    return "".join(out)


def _pairs(s: Scanner) -> dict[str, str] | None:
    """Top-level key and value pairs of a ``{"k": v}`` or ``k=v`` line, None if it is neither."""
    out: dict[str, str] = {}
    if _mark(s, 0, "{"):
        k, depth, key, value_at = 1, 1, None, None
        while True:
            kind, text, end = s.token(k)
            if kind == END:
                return None
            if depth == 1 and kind == QUOTE and key is None:
                key = _unquote(text)
            elif depth == 1 and key is not None and value_at is None and text == ":":
                value_at = end
            elif depth == 1 and text in (",", "}") and kind == MARK:
                if key is not None and value_at is not None:
                    out[key] = _unquote(s.line[value_at : s.start(k)].strip())
                key = value_at = None
                if text == "}":
                    rest = s.line[end:].strip()
                    return out if not rest else None
            elif kind == MARK and text in "{[":
                depth += 1
            elif kind == MARK and text in "}]":
                depth -= 1
            k += 1
    k = 0
    while True:
        kind, text, end = s.token(k)
        if kind == END:
            break
        if kind == BLANK:
            k += 1
            continue
        first = s.start(k)
        while s.token(k)[0] in (ALPHA, DIGIT) or _mark(s, k, "@._-"):
            k += 1
        if s.start(k) == first or not _mark(s, k, "="):
            return None if not out or len(out) < 2 else out
        key, k = s.line[first : s.start(k)], k + 1
        if s.token(k)[0] == QUOTE:
            out[key] = _unquote(s.token(k)[1])
            k += 1
        else:
            first = s.start(k)
            while s.token(k)[0] not in (BLANK, END):
                k += 1
            out[key] = s.line[first : s.start(k)]
    return out


def _structured(s: Scanner, year: int) -> tuple[dt.datetime, str, str, str] | None:
    first = s.token(0)
    if not (_mark(s, 0, "{@") or first[0] == ALPHA and _mark(s, 1, "=.@_")):
        return None
    pairs = _pairs(s)
    if not pairs:
        return None

    def of(keys: set[str]) -> str:
        return next((v for key, v in pairs.items() if key.lower() in keys), "")

    stamp = Scanner(of(TIME_KEYS).strip())
    got = read_time(stamp, 0, year)
    if got is None or stamp.token(got[1])[0] != END:
        return None
    level = LEVEL_OF.get(of(LEVEL_KEYS).strip().upper(), "")
    name = of(NAME_KEYS).strip()
    scan = Scanner(name)
    named = _name(scan, 0)
    return got[0], level, named[0] if named else name, of(TEXT_KEYS)


#: The number of a structured line's layout, besides those of the grammars.
STRUCTURED = -1


def read_head(line: str, year: int, day: tuple[int, int] = (1, 1)) -> tuple[int, dt.datetime, str, str, str] | None:
    """The layout's number, time, level, component and first message line of an entry that may begin here; None for none."""
    if not line or line[0] in " \t":
        return None
    s = Scanner(line)
    if got := _structured(s, year):
        return STRUCTURED, *got
    times: dict = {}
    for number, grammar in enumerate(GRAMMARS):
        if got := _apply(grammar, s, year, times, day):
            at, level, name, end = got
            return number, at, level, name, line[end:].strip()
    return None


def read_entry(line: str, year: int, day: tuple[int, int] = (1, 1)) -> tuple[str, str, str, str] | None:
    """The time, level, component and first message line of an entry that begins here; None for a continuation."""
    got = read_head(line, year, day)
    return got and (got[1].strftime("%Y-%m-%d %H:%M:%S"), *got[2:])


#: So far the clocks of programs that share a file may differ.
SKEW = dt.timedelta(hours=1)
CLOSING = {"{": "}", "[": "]", "(": ")"}


class Lookahead:
    """Decides whether a line that a grammar accepts begins an entry or continues the one before it.

    The state is the entry's head and the bracket that a line of it ended in and nothing has closed. These attach a line:

    * an open bracket: the line has another layout than the entry's head, and a line that begins with the closing bracket
      comes before the next line of that layout;
    * times out of order: the line is but a time and text, no other line of the file has its layout, the head states a level
      or component, and the line's time lies outside those of the head and of the next line that states one, which are in
      order. Programs that share a file needn't agree on the time, so it must lie outside by more than SKEW,
    * unless there is indentation: between indented lines, as within a trace, any time out of order will do.
    """

    def __init__(self, lines: list[str], heads: dict[int, tuple]):
        self.lines, self.heads = lines, heads
        self.open = ""

    @cached_property
    def closings(self) -> dict[str, list[int]]:
        """Line numbers by the closing bracket that the line begins with."""
        out: dict[str, list[int]] = defaultdict(list)
        for k, line in enumerate(self.lines):
            if (first := line.lstrip(" \t")[:1]) in CLOSING.values():
                out[first].append(k)
        return out

    @cached_property
    def by_layout(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = defaultdict(list)
        for k, head in self.heads.items():
            out[head[0]].append(k)
        return out

    @cached_property
    def stating(self) -> list[int]:
        """Numbers of the lines whose head states a level or a component."""
        return [k for k, head in self.heads.items() if head[2] or head[3]]

    @staticmethod
    def _next(numbers: list[int], k: int) -> int | None:
        at = bisect_right(numbers, k)
        return numbers[at] if at < len(numbers) else None

    def read(self, k: int) -> None:
        """Takes in a line of the entry: what it leaves open or closes."""
        line = self.lines[k].rstrip(" \t")
        if self.open and line.lstrip(" \t")[:1] == self.open:
            self.open = ""
        if line[-1:] in CLOSING:
            self.open = CLOSING[line[-1]]

    def begins(self, k: int) -> None:
        """A new entry begins: nothing is open but by this line."""
        self.open = ""
        self.read(k)

    def _indented(self, k: int, step: int) -> bool:
        return 0 <= k + step < len(self.lines) and self.lines[k + step][:1] in (" ", "\t") and bool(self.lines[k + step].strip(" \t"))

    def continues(self, k: int, head: int) -> bool:
        """Whether line k continues the entry that begins at line ``head``."""
        own, first = self.heads[k], self.heads[head]
        if self.open and own[0] != first[0]:
            end, same = self._next(self.closings.get(self.open, []), k), self._next(self.by_layout[first[0]], k)
            if end is not None and (same is None or end < same):
                return True
        if own[2] or own[3] or len(self.by_layout[own[0]]) > 1 or not (first[2] or first[3]):
            return False
        after = self._next(self.stating, k)
        last = self.heads[after][1] if after is not None else None
        if last is not None and last < first[1]:
            return False
        skew = dt.timedelta(0) if self._indented(k, -1) and self._indented(k, 1) else SKEW
        return own[1] < first[1] - skew or last is not None and own[1] > last + skew


def parse_text(text: str, year: int, day: tuple[int, int] = (1, 1)) -> list[tuple[int, str, str, str, str, int]]:
    """All entries of one file: line number, time, level, component, message, number of lines."""
    lines = [line.rstrip("\r") for line in text.split("\n")]
    heads = {k: got for k, line in enumerate(lines) if (got := read_head(line, year, day)) is not None}
    ahead = Lookahead(lines, heads)
    starts: list[int] = []
    for k in range(min(heads, default=len(lines)), len(lines)):
        if k in heads and not (starts and ahead.continues(k, starts[-1])):
            starts.append(k)
            ahead.begins(k)
        else:
            ahead.read(k)
    out = []
    for first, end in zip(starts, [*starts[1:], len(lines)]):
        last = next(k for k in range(end - 1, first - 1, -1) if k == first or lines[k].strip(" \t"))
        _, at, level, name, message = heads[first]
        out.append((first + 1, at.strftime("%Y-%m-%d %H:%M:%S"), level, name, "\n".join([message, *lines[first + 1 : last + 1]]), last - first + 1))
    return out


def _date(stamp: object) -> tuple[int, tuple[int, int]]:
    """Year, and month and day, of an ISO time; 1970 and the first of January where they are missing."""
    text = str(stamp or "")
    year = int(text[:4]) if text[:4].isdigit() and text[:4] > "0000" else 1970
    month, day = (int(x) if x.isdigit() else 1 for x in (text[5:7], text[8:10]))
    return year, (month, day) if 1 <= month <= 12 and 1 <= day <= 31 else (1, 1)


def _entries(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = SCHEMA.fieldNames()
    for part in parts:
        rows = []
        for path, text, stamp in zip(part["source_path"], part["text"], part["stamp"]):
            if text is not None:
                rows += [(path, *entry) for entry in parse_text(text, *_date(stamp))]
        yield pd.DataFrame(rows, columns=names)


def parse_logs(files: DataFrame, path: str = "source_path", text: str = "text", metadata: str = "metadata") -> DataFrame:
    """One row per log entry of every file in ``files``.

    Returns source_path, line_no (from 1), entry_ts (``yyyy-MM-dd HH:mm:ss`` UTC, fraction cut off), entry_level
    (DEBUG, INFO, WARN, ERROR, FATAL or ''), component ('' if none), message (whole, continuation lines included) and
    n_lines (to the last line that isn't blank before the next entry).

    A null or empty text gives no rows, as do lines before the first entry. A null map or one without
    ``file_modified_at`` makes a missing year 1970 (and a missing date the first of January). Files that occur twice, word for word, are parsed once; other columns
    of ``files`` are ignored, whatever their names. A table without rows gives none.
    """
    pruned = files.select(F.col(path).alias("source_path"), F.col(text).alias("text"), F.col(metadata)["file_modified_at"].alias("stamp"))
    return pruned.mapInPandas(_entries, SCHEMA).distinct()


def log_files(parsed: DataFrame) -> DataFrame:
    """The rows of a table of parsed files that are logs by their path."""
    return parsed.filter(F.col("source_path").rlike(r"\.(log|log\.1|out)$"))
