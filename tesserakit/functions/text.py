"""Text, path and vector functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that count as whitespace when text is split into words.
SPACE = r"[\s\x1c-\x1f\x85\xa0  -     　]"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: str | Column) -> Column:
    """Lower-cased words between whitespace; punctuation stays. Null gives null, blank text an empty array."""
    return F.filter(F.split(F.lower(_c(text)), SPACE + "+"), lambda t: t != "")


def strip(text: str | Column) -> Column:
    """Text without whitespace at either end."""
    return F.regexp_replace(_c(text), f"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: str | Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def normal_newlines(text: str | Column) -> Column:
    """Carriage returns, alone or before a line feed, as line feeds."""
    return F.regexp_replace(_c(text), "\r\n?", "\n")


def file_name(path: str | Column) -> Column:
    return F.substring_index(_c(path), "/", -1)


def suffix(path: str | Column) -> Column:
    """The last extension in lower case with its dot, '' if none; a leading dot is no extension."""
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1))


def stem(path: str | Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product in doubles."""
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def norm(a: str | Column) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(a: str | Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(a)
    return F.transform(_c(a), lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def sigmoid(x: str | Column) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(x)))


def min_max(score: Column, low: Column, high: Column) -> Column:
    """Scaled to [0, 1]; where all scores are equal, to 0."""
    width = high - low
    return (score - low) / F.when(width == 0, F.lit(1.0)).otherwise(width)


def band(score: str | Column) -> Column:
    """A score's label: high from 0.6, mid from 0.35, else low; null for null."""
    s = _c(score)
    return F.when(s >= 0.6, "high").when(s >= 0.35, "mid").when(s.isNotNull(), "low")


def for_embedding(text: str | Column) -> Column:
    """Text as an embedding model takes it: no NUL characters, a blank for null or blank text."""
    clean = F.replace(F.coalesce(_c(text), F.lit("")), F.lit("\x00"), F.lit(""))
    return F.when(is_blank(clean), F.lit(" ")).otherwise(clean)


def iso_utc(seconds: str | Column) -> Column:
    """Epoch seconds as ISO 8601 in UTC, to the second."""
    return F.date_format(F.timestamp_seconds(F.floor(_c(seconds))), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def map_get(m: str | Column, key: str, default: str = "") -> Column:
    return F.coalesce(F.try_element_at(_c(m), F.lit(key)), F.lit(default))


@F.pandas_udf(T.StringType())
def content_hash(text: pd.Series) -> pd.Series:
    """xxh64, seed 0, of the text's UTF-8 bytes in hex; '' for null."""
    import xxhash

    return text.map(lambda t: "" if t is None else xxhash.xxh64_hexdigest(t.encode("utf-8", "surrogatepass")))


@F.pandas_udf(T.StringType())
def title_case(text: pd.Series) -> pd.Series:
    """Every run of letters begun with a capital, as in a title made of a file's name."""
    return text.str.title()
