"""Near-duplicate texts by a prefix-filtered similarity join.

Tokens of a text are its distinct runs of successive words. Two texts whose Jaccard similarity is at
least t must share a token among the first n - ceil(t n) + 1 tokens of either one in any common
order; with the rarest tokens first, few texts meet there. The stages, none of which gathers more
than a block of texts or a range of token hashes in one task:

1. ``_pack``: over the scan, without a shuffle, each block of texts becomes its tokens' hashes,
   packed per range of the hash space (3 bytes a token). A token that LOCAL texts of a block have
   goes to its range once, with its count; which texts have it stays with the block.
2. ``_count``: per range, the number of texts of every token, over all texts; tokens of one text
   only can never be shared and go no further. The rest go back to their block with a rarity code.
3. ``_prefixes``: per block, each text's tokens rare-first; its prefix goes back to the ranges, packed.
   With prefixes longer by SHARED - 1, similar texts share SHARED tokens in them (or as many as they
   must have in common at all), so pairs that met by one chance token go no further.
4. ``_pairs``: per range, the texts of each token are paired under the length and the positional filter.
   Tokens of crowds of texts never enter a range: they take a join on token and length (``_crowds``),
   which can be divided.
5. ``_suffixes``: each distinct pair is held against histograms of the two token sets, whose lesser
   counts bound what the sets have in common, and then
6. ``_verify``: once per pair, the exact similarity from the two texts.

Word-for-word copies are collapsed to one text first (by a 128-bit digest, aggregated map-side), so
a group of copies of any size costs one text. Any order gives the right result, so codes may be coarse.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spark_util import cut_lineage

#: Characters of text that are packed together and of a range of the hash space, in inputs of up to FEW characters. Both grow with
#: the root of the input's size, up to GROWTH times, so that what a block has for a range stays worth a row. They bound the
#: memory of a task, not what is looked at.
BLOCK_CHARS, RANGE_CHARS, FEW, GROWTH = 4_000_000, 3_000_000, 2_000_000_000, 4.0
#: Words kept with their hashes by one Python process; a speed-up only.
CACHE = 1_000_000
BUCKETS = 64
#: The greatest count that an outline holds; it stands for any from there on.
FULL = 65_535


_WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")


def words(text: str) -> list[str]:
    """Maximal runs of letters, combining marks and decimal digits, in lower case."""
    text = text.lower()
    return (_ASCII_WORD if text.isascii() else _WORD).findall(text)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_HASHES = _Hashes()


def tokens(text: str, length: int, least_words: int, salt: int) -> np.ndarray | None:
    """Sorted distinct 64-bit hashes of the runs of ``length`` words; None for a text with too few words."""
    found = words(text)
    if len(found) < max(least_words, length):
        return None
    h = np.array([_HASHES[w] for w in found], dtype=np.uint64)
    n = len(h) - length + 1
    out = np.full(n, salt, dtype=np.uint64)
    for k in range(length):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


_IN, _OUT = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _zip(*arrays: np.ndarray) -> bytes:
    return _IN.compress(b"".join(a.tobytes() for a in arrays))


def _unzip(data: bytes) -> bytes:
    return _OUT.decompress(data)


PACKED = T.StructType(
    [
        T.StructField("range", T.IntegerType()),
        T.StructField("block", T.LongType()),
        T.StructField("docs", T.IntegerType()),
        T.StructField("heads", T.BinaryType()),
        T.StructField("data", T.BinaryType()),
    ]
)
RARE = "range int, block long, data binary"
PAIRS = "key_a long, key_b long, n_a int, n_b int, c int"
HOT = "token long, key long, n int, pos int"
OUTLINE = "key long, doc long, outline binary"
#: Tokens that a pair must share in its prefixes, which are longer by one less.
SHARED = 4
#: A token of so many texts of a block is counted there.
LOCAL = 4
#: Texts with one token that one task pairs; a token of more goes through a join that can be divided.
CROWD = 20_000
#: Pairs held at once.
CHUNK = 2_000_000
#: A text within its block: its number, its count of tokens, the first half of its digest.
HEAD = np.dtype([("at", np.uint32), ("n", np.uint32), ("doc", np.int64)])


def _three(low: np.ndarray) -> np.ndarray:
    """Numbers below 2^24 in three bytes each."""
    return np.ascontiguousarray(low.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])


def _from_three(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), dtype=np.uint8)
    out[:, :3] = data.reshape(-1, 3)
    return out.view("<u4").ravel()


def _doc(ident: bytes) -> int:
    return int.from_bytes(ident[:8], "big", signed=True)


@dataclass
class Frame:
    """What a block has in one range: texts with so many tokens each, the tokens by text (with codes), tokens counted in the block (with counts or codes)."""

    who: np.ndarray
    counts: np.ndarray
    low: np.ndarray
    code: np.ndarray
    own_low: np.ndarray
    own_count: np.ndarray

    def pack(self) -> bytes:
        sizes = np.array([len(self.who), len(self.low), len(self.own_low), len(self.code)], dtype=np.uint32)
        step = np.diff(self.who, prepend=np.uint32(0)).astype(np.uint32)  # small numbers pack well
        return _zip(sizes, step, self.counts.astype(np.uint32), self.own_count.astype(np.uint32), _three(self.low), _three(self.own_low), self.code.astype(np.uint8))

    @staticmethod
    def unpack(data: bytes) -> Frame:
        body = _unzip(data)
        d, n, q, c = np.frombuffer(body, np.uint32, 4).tolist()
        numbers = np.frombuffer(body, np.uint32, 2 * d + q, 16)
        at = 16 + 4 * (2 * d + q)
        low, own = (_from_three(np.frombuffer(body, np.uint8, 3 * m, k)) for m, k in ((n, at), (q, at + 3 * n)))
        return Frame(np.cumsum(numbers[:d], dtype=np.uint32), numbers[d : 2 * d], low, np.frombuffer(body, np.uint8, c, at + 3 * (n + q)), own, numbers[2 * d :])


def _aside(block: int, ranges: int) -> int:
    """A number below 0, in place of a range, for what a block keeps to itself."""
    return -1 - block % ranges


def _pack(salts: dict[str, int], length: int, least_words: int, ranges: int, block_chars: int, local: int):
    def flush(docs: list[tuple[int, np.ndarray]], number: int) -> pd.DataFrame:
        heads = np.zeros(len(docs), dtype=HEAD)
        heads["at"] = np.arange(len(docs))
        heads["n"] = [len(t) for _, t in docs]
        heads["doc"] = [d for d, _ in docs]
        # a task that is run again gives its blocks the same names; no two blocks have one
        task = TaskContext.get()
        block = int(xxhash.xxh3_64_intdigest(heads.tobytes() + f"{task.partitionId() if task else 0} {number}".encode())) >> 2
        every = np.concatenate([t for _, t in docs])
        of = np.repeat(heads["at"], heads["n"])
        token = (every >> np.uint64(32)) % np.uint64(ranges) << np.uint64(24) | every & np.uint64(0xFFFFFF)
        ordered = np.sort(token)
        crowded = np.unique(ordered[local - 1 :][ordered[local - 1 :] == ordered[: max(0, len(ordered) - local + 1)]])
        rows = []
        own_ends, own_count = np.zeros(ranges + 1, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if len(crowded):
            place = np.minimum(np.searchsorted(crowded, token), len(crowded) - 1)
            counted = crowded[place] == token
            order = np.argsort(place[counted], kind="stable")
            own_count = np.bincount(place[counted], minlength=len(crowded))
            rows.append((_aside(block, ranges), block, len(docs), b"", _zip(np.array([len(crowded)], dtype=np.uint64), crowded, own_count.astype(np.uint32), of[counted][order])))
            token, of = token[~counted], of[~counted]
            own_ends = np.searchsorted(crowded >> np.uint64(24), np.arange(ranges + 1))
        bucket = (token >> np.uint64(24)).astype(np.uint16 if ranges <= 65_536 else np.uint32)
        order = np.argsort(bucket, kind="stable")  # by range, then text, then token
        low, of, bucket = (token[order] & np.uint64(0xFFFFFF)).astype(np.uint32), of[order], bucket[order]
        ends = np.searchsorted(bucket, np.arange(ranges + 1))
        home = (heads["doc"].astype(np.uint64) % np.uint64(ranges)).astype(np.int64)
        by_home = np.argsort(home, kind="stable")
        home_ends = np.searchsorted(home[by_home], np.arange(ranges + 1))
        used = np.flatnonzero((np.diff(ends) > 0) | (np.diff(own_ends) > 0) | (np.diff(home_ends) > 0))
        none = np.zeros(0, dtype=np.uint8)
        for r in used.tolist():
            a, b, x, y = ends[r], ends[r + 1], own_ends[r], own_ends[r + 1]
            first = np.flatnonzero(np.diff(of[a:b], prepend=-1)) if b > a else np.zeros(0, dtype=np.int64)
            frame = Frame(of[a:b][first], np.diff(np.append(first, b - a)), low[a:b], none, (crowded[x:y] & np.uint64(0xFFFFFF)).astype(np.uint32), own_count[x:y])
            rows.append((r, block, len(docs), _zip(heads[by_home[home_ends[r] : home_ends[r + 1]]]), frame.pack()))
        return pd.DataFrame(rows, columns=PACKED.fieldNames())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, size, seen, number = [], 0, set(), 0
        for part in parts:
            for kind, ident, text in zip(part["kind"], part["id"], part["text"]):
                doc = _doc(ident)
                if doc in seen:
                    continue
                seen.add(doc)
                found = tokens(text, length, least_words, salts[kind])
                if found is None:
                    continue
                docs.append((doc, found))
                size += len(text)
                if size >= block_chars:
                    yield flush(docs, number)
                    docs, size, seen, number = [], 0, set(), number + 1
        if docs:
            yield flush(docs, number)

    return run


def _count(part: pd.DataFrame) -> pd.DataFrame:
    """The tokens of one range that two texts or more have, back by block, with a code that grows with their number of texts.

    A text that several blocks hold stays with the least of them: the digests of one range's texts meet here too. What
    blocks keep to themselves passes through.
    """
    if part["range"].iloc[0] < 0:
        return part
    frames = [Frame.unpack(data) for data in part["data"]]
    heads_of = [np.frombuffer(_unzip(heads), dtype=HEAD) for heads in part["heads"]]
    n = sum(len(f.low) for f in frames)
    every = np.concatenate([f.low for f in frames] + [f.own_low for f in frames])
    weight = np.concatenate([np.ones(n, dtype=np.int64), *(f.own_count for f in frames)])
    _, inverse = np.unique(every, return_inverse=True)
    df = np.bincount(inverse, weights=weight)
    code = np.minimum(255, np.ceil(8 * np.log2(np.maximum(df, 1)))).astype(np.uint8)[inverse]
    owner: dict[int, int] = {}
    for block, heads in zip(part["block"], heads_of):
        for doc in heads["doc"].tolist():
            owner[doc] = min(owner.get(doc, block), block)
    rows, at, own_at = [], 0, n
    for r, block, docs, f, heads in zip(part["range"], part["block"], part["docs"], frames, heads_of):
        own = code[at : at + len(f.low)]
        kept = own > 0
        of = np.repeat(np.arange(len(f.who)), f.counts)[kept]
        counts = np.bincount(of, minlength=len(f.who))
        crowded = code[own_at : own_at + len(f.own_low)]
        at, own_at = at + len(f.low), own_at + len(f.own_low)
        mine = heads[[owner[d] == block for d in heads["doc"].tolist()]] if len(heads) else heads
        if len(mine) or kept.any() or len(crowded):
            rows.append((r, block, docs, _zip(mine), Frame(f.who[counts > 0], counts[counts > 0], f.low[kept], own[kept], f.own_low, crowded).pack()))
    return pd.DataFrame(rows, columns=PACKED.fieldNames())


def prefix_size(n: np.ndarray, t: float) -> np.ndarray:
    """So many of a text's rarest tokens hold one in common with any text similar to it by t."""
    return n - np.ceil(t * n - 1e-9).astype(np.int64) + 1


def _block(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one block: its own texts' heads, and text number, token and code of all tokens that can be shared."""
    part = part.sort_values("range", kind="stable")
    of, token, code, heads, crowded, aside = [], [], [], [np.zeros(0, dtype=HEAD)], [np.zeros(0, dtype=np.uint8)], None
    for r, head, data in zip(part["range"], part["heads"], part["data"]):
        if r < 0:
            aside = _unzip(data)
            continue
        f = Frame.unpack(data)
        of.append(np.repeat(f.who, f.counts))
        token.append(f.low.astype(np.int64) | np.int64(r) << np.int64(24))
        code.append(f.code)
        crowded.append(f.own_count.astype(np.uint8))  # codes, on the way back; by range and token, as the block has them
        heads.append(np.frombuffer(_unzip(head), HEAD))
    if aside is not None:
        q = int(np.frombuffer(aside, np.uint64, 1)[0])
        times = np.frombuffer(aside, np.uint32, q, 8 + 8 * q)
        of.append(np.frombuffer(aside, np.uint32, -1, 8 + 12 * q))
        token.append(np.repeat(np.frombuffer(aside, np.int64, q, 8), times))
        code.append(np.repeat(np.concatenate(crowded), times))
    of, token, code, heads = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (of, token, code, heads))
    number = np.full(int(part["docs"].iloc[0]), -1)
    number[heads["at"]] = np.arange(len(heads))
    own = number[of] >= 0
    return heads, number[of[own]], token[own], code[own]


def _prefixes(t: float, ranges: int, crowd: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        heads, of, token, code = _block(part)
        n = heads["n"].astype(np.int64)
        order = np.lexsort((token, code, of))
        of, token, code = of[order], token[order], code[order]
        shared = np.bincount(of, minlength=len(n))
        # tokens of no other text are the rarest and stand in front
        pos = np.arange(len(of)) - np.repeat(np.cumsum(shared) - shared, shared) + (n - shared)[of]
        kept = pos < prefix_size(n, t)[of] + SHARED - 1
        of, token, pos, code = of[kept], token[kept], pos[kept], code[kept]
        order = np.argsort(token, kind="stable")
        of, token, pos, code = of[order], token[order], pos[order], code[order]
        block = int(part["block"].iloc[0])
        rows = []
        hot = code > np.floor(8 * np.log2(crowd))  # of more texts than ``crowd``, or nearly
        if hot.any():
            who = of[hot]
            columns = token[hot], heads["at"][who].astype(np.int64) + block, heads["n"][who].astype(np.int64), pos[hot].astype(np.int64)
            rows.append((_aside(block, ranges), block, _zip(*columns)))
            of, token, pos = of[~hot], token[~hot], pos[~hot]
        where = token >> 24
        for r in np.unique(where).tolist():
            own = slice(*np.searchsorted(where, [r, r + 1]))
            who = of[own]
            columns = heads["at"][who], heads["n"][who], pos[own].astype(np.uint32)
            rows.append((r, block, _zip(_three(token[own] & 0xFFFFFF), *(np.ascontiguousarray(c) for c in columns))))
        return pd.DataFrame(rows, columns=["range", "block", "data"])

    return run


def _range(part: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Of one range, in order of token: token, text, its count of tokens, place in its prefix; and where each token's texts end."""
    low, key, n, pos = [], [], [], []
    for block, data in zip(part["block"], part["data"]):
        body = _unzip(data)
        m = len(body) // 15
        low.append(_from_three(np.frombuffer(body, np.uint8, 3 * m)))
        at, size, place = np.frombuffer(body, np.uint8, -1, 3 * m).copy().view(np.uint32).reshape(3, m)
        key.append(at.astype(np.int64) + block)
        n.append(size.astype(np.int64))
        pos.append(place.astype(np.int64))
    low, key, n, pos = map(np.concatenate, (low, key, n, pos))
    order = np.lexsort((key, n, low))
    low, key, n, pos = low[order], key[order], n[order], pos[order]
    return low, key, n, pos, np.searchsorted(low, low, side="right")


def _need(n_a, n_b, t: float):  # noqa: ANN001, ANN202
    """So many tokens two texts similar by t have in common."""
    return t / (1 + t) * (n_a + n_b) - 1e-6


def _pairs(t: float):
    """Pairs of texts with a common token in their prefixes, under the length and the positional filter, with their number of such tokens.

    Texts of a token come in order of size; of a common token that isn't the first, the filter allows for those before it.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        if part["range"].iloc[0] < 0:
            return pd.DataFrame({c.split()[0]: np.zeros(0, dtype=np.int64) for c in PAIRS.split(", ")})
        low, key, n, pos, end = _range(part)
        later = end - np.arange(len(low)) - 1
        total = np.cumsum(later)
        found, first = [], 0
        while first < len(low):
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + CHUNK, side="right")))
            own = np.arange(first, last)
            a = np.repeat(own, later[own])
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(later[own]) - later[own], later[own])
            good = n[a] >= t * n[b] - 1e-6
            a, b = a[good], b[good]
            good = np.minimum(n[a] - pos[a], n[b] - pos[b]) >= _need(n[a], n[b], t) - (SHARED - 1)
            a, b = a[good], b[good]
            swap = key[a] > key[b]
            x, y = np.where(swap, b, a), np.where(swap, a, b)
            found.append(np.stack((key[x], key[y], n[x], n[y]), axis=1))
            first = last
        rows = np.concatenate(found)
        if len(rows):
            rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
            new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
            counts = np.diff(np.r_[np.flatnonzero(new), len(rows)])
            rows = rows[new]
        else:
            counts = np.zeros(0, dtype=np.int64)
        return pd.DataFrame({"key_a": rows[:, 0], "key_b": rows[:, 1], "n_a": rows[:, 2], "n_b": rows[:, 3], "c": counts})

    return run


def _hot(part: pd.DataFrame) -> pd.DataFrame:
    """The texts of crowds' tokens, one row each; a range has none."""
    aside = [np.frombuffer(_unzip(data), np.int64).reshape(4, -1) for data in part["data"]] if part["range"].iloc[0] < 0 else []
    return pd.DataFrame(np.concatenate([np.zeros((4, 0), dtype=np.int64), *aside], axis=1).T, columns=["token", "key", "n", "pos"])


def _crowds(hot: DataFrame, t: float) -> DataFrame:
    """Pairs of the texts of crowds' tokens, as of ``_pairs``.

    Lengths fall into classes, each reaching as far as similar lengths may differ, so a text meets those of its own class and
    the next only; the join's key is token and class, which AQE can divide further.
    """
    size = (F.floor(F.log(F.col("n")) / F.lit(-1.000001 * math.log(t))) if t < 1 else F.col("n")).cast("long")
    classed = hot.withColumn("class", size)
    a, b = (classed.select("token", "class", *(F.col(c).alias(f"{c}_{s}") for c in ("key", "n", "pos"))) for s in "ab")
    need = F.lit(t / (1 + t)) * (F.col("n_a") + F.col("n_b")) - 1e-6
    # the shorter one, a, is of the longer one's class or the class before
    b = b.withColumn("class", F.explode(F.array("class", F.col("class") - 1)))
    pairs = a.join(b, ["token", "class"]).filter((F.col("n_a") < F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("key_a") < F.col("key_b")))
    pairs = pairs.filter(F.col("n_a") >= F.lit(t) * F.col("n_b") - 1e-6).filter(F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= need - (SHARED - 1))
    turned = F.col("key_a") > F.col("key_b")
    columns = [F.when(turned, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}") for c in ("key", "n") for x, y in (("a", "b"), ("b", "a"))]
    return pairs.select(*columns, F.lit(1).alias("c"))


def _outlines(part: pd.DataFrame) -> pd.DataFrame:
    """Of each text, how many of its tokens that can be shared fall into each of some parts of the hash space."""
    heads, of, token, _ = _block(part)
    bucket = (token.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58)).astype(np.int64)
    counts = np.bincount(of * BUCKETS + bucket, minlength=len(heads) * BUCKETS)
    counts = np.minimum(counts, FULL).astype(np.uint16).reshape(-1, BUCKETS)
    return pd.DataFrame({"key": heads["at"].astype(np.int64) + part["block"].iloc[0], "doc": heads["doc"], "outline": pd.Series([c.tobytes() for c in counts], dtype=object)})


def _suffixes(t: float):
    """Suffix filter: the common tokens are at most the sum of the lesser counts in each part of the hash space."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                x, y = (np.frombuffer(b"".join(part[c]), np.uint16).reshape(-1, BUCKETS) for c in ("outline_a", "outline_b"))
                least = np.minimum(x, y)
                enough = least.sum(axis=1) >= t / (1 + t) * (part["n_a"] + part["n_b"]) - 1e-6
                part = part[enough | (least == FULL).any(axis=1)]  # a full part is no bound
            yield part[["doc_a", "doc_b"]]

    return run


def _verify(salts: dict[str, int], length: int, least_words: int, t: float):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[bytes, np.ndarray] = {}

        def of(kind: str, ident: bytes, text: str) -> np.ndarray:
            ident = bytes(ident)
            if ident not in memo:
                if len(memo) > 2000:
                    memo.clear()
                memo[ident] = tokens(text, length, least_words, salts[kind])
            return memo[ident]

        for part in parts:
            similarity = []
            for kind, a, b, x, y in zip(part["kind"], part["id_a"], part["id_b"], part["text_a"], part["text_b"]):
                p, q = of(kind, a, x), of(kind, b, y)
                if p is None or q is None:
                    similarity.append(-1.0)
                    continue
                either = len(np.unique(np.concatenate((p, q))))
                similarity.append((len(p) + len(q) - either) / either)
            out = part[["kind", "id_a", "id_b"]].assign(similarity=similarity)
            yield out[out["similarity"] >= t - 1e-9]

    return run


def digest() -> F.Column:
    """What names a text within its kind."""
    return F.unhex(F.md5(F.concat_ws("\n", "kind", "text")))


def texts_with_ids(rows: DataFrame) -> DataFrame:
    """kind, key, text and a digest of kind and text (copies share it), without null or empty texts."""
    return rows.select("kind", "key", "text", digest().alias("id")).filter("kind is not null and key is not null and length(text) > 0")


def _sizes(rows: DataFrame) -> tuple[int, int]:
    """Ranges of the hash space (a power of two) and characters of a block, by the input's size; see BLOCK_CHARS."""
    size = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    growth = min(GROWTH, max(1.0, math.sqrt(size / FEW)))
    return 1 << max(2, math.ceil(math.log2(max(1, size) / (RANGE_CHARS * growth)))), round(BLOCK_CHARS * growth)


def similar_texts(rows: DataFrame, kinds: list[str], length: int = 5, threshold: float = 0.8, least_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """kind, id_a, id_b and similarity of every pair of different texts of one kind at or above ``threshold``; and the
    ``first_half`` of the ids of long enough texts that several keys have.

    ``rows`` has kind, key, text and id, as of ``texts_with_ids``; kinds are compared only within themselves.
    """
    salts = {k: i + 1 for i, k in enumerate(kinds)}
    ranges, block_chars = _sizes(rows)
    packed = rows.select("kind", "id", "text").mapInPandas(_pack(salts, length, least_words, ranges, block_chars, LOCAL), PACKED)
    blocks = packed.groupBy("range").applyInPandas(_count, PACKED).groupBy("block")
    rare = blocks.applyInPandas(_prefixes(threshold, ranges, CROWD), RARE).groupBy("range")
    need = F.lit(threshold / (1 + threshold)) * (F.col("n_a") + F.col("n_b")) - 1e-6
    pairs = rare.applyInPandas(_pairs(threshold), PAIRS).unionByName(_crowds(rare.applyInPandas(_hot, HOT), threshold))
    pairs = pairs.groupBy("key_a", "key_b", "n_a", "n_b").agg(F.sum("c").alias("c"))
    pairs = pairs.filter(F.col("c") >= F.least(F.lit(float(SHARED)), need)).select("key_a", "key_b", "n_a", "n_b")
    outlines = blocks.applyInPandas(_outlines, OUTLINE)
    copied = rows.groupBy("id").agg(F.min("key").alias("x"), F.max("key").alias("y")).filter("x < y").select(first_half("id").alias("doc"))
    copied = copied.join(outlines.select("doc"), "doc").select(F.col("doc").alias("doc_a"), F.col("doc").alias("doc_b"))
    for s in "ab":
        pairs = pairs.join(outlines.select(*(F.col(c).alias(f"{c}_{s}") for c in ("key", "doc", "outline"))), f"key_{s}")
    both = cut_lineage(pairs.mapInPandas(_suffixes(threshold), "doc_a long, doc_b long").unionByName(copied))
    pairs, copied = both.filter("doc_a < doc_b or doc_a > doc_b"), both.filter("doc_a = doc_b").select(F.col("doc_a").alias("doc"))
    keyed = rows.select("kind", "id", "text", first_half("id").alias("doc"))
    wanted = pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("doc")).distinct()
    texts = keyed.join(wanted, "doc", "left_semi").groupBy("doc", "id").agg(F.first("kind").alias("kind"), F.first("text").alias("text"))
    for s in "ab":
        pairs = pairs.join(texts.select(*(F.col(c).alias(f"{c}_{s}") for c in ("doc", "id", "kind", "text"))), f"doc_{s}")
    verified = (
        pairs.filter("kind_a = kind_b")
        .select(F.col("kind_a").alias("kind"), "id_a", "id_b", "text_a", "text_b")
        .mapInPandas(_verify(salts, length, least_words, threshold), "kind string, id_a binary, id_b binary, similarity double")
    )
    return verified, copied


def first_half(ident: str) -> F.Column:
    """The number that ``_doc`` makes of a digest."""
    return F.conv(F.substring(F.hex(ident), 1, 16), 16, -10).cast("long")


def near_duplicates(rows: DataFrame, kinds: list[str], length: int = 5, threshold: float = 0.8, least_words: int = 0) -> DataFrame:
    """All pairs of records with similar texts: kind, key_a, key_b.

    ``rows`` has kind, key and text. Records are compared within their kind by the Jaccard similarity of their distinct
    runs of ``length`` words; word-for-word copies are similar. Texts with fewer than ``least_words`` words (or than
    ``length``), null or empty texts, null keys and kinds that aren't named are left out. Rows that occur twice count
    once; ties at the threshold are in; extra columns play no part; a table without rows gives none.
    """
    rows = texts_with_ids(rows).filter(F.col("kind").isin(kinds))
    pairs, copied = similar_texts(rows, kinds, length, threshold, least_words)
    members = rows.select("kind", "key", "id").distinct()
    a, b = (members.select(F.col("key").alias(f"key_{s}"), F.col("id").alias(f"id_{s}")) for s in "ab")
    across = pairs.select("kind", "id_a", "id_b").join(a, "id_a").join(b, "id_b").select("kind", "key_a", "key_b")
    own = members.withColumn("doc", first_half("id")).join(copied, "doc", "left_semi")
    # the result itself has every pair of copies, so these rows are no more than it has
    copies = own.select("kind", "id", F.col("key").alias("key_a")).join(own.select("id", F.col("key").alias("key_b")), "id").filter("key_a < key_b")
    return across.select("kind", F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).unionByName(copies.drop("id"))


def classes_and_links(rows: DataFrame, kinds: list[str], length: int = 5, threshold: float = 0.8, least_words: int = 0) -> DataFrame:
    """One row per record: kind, key, class_key (the least key with this very text) and links.

    ``links`` counts the other texts that are similar to the record's text. Copies are not expanded, so the result
    has one row per record however many copies there are. Records without text have class_key null and no links.
    """
    keyed = rows.select("kind", "key", "text").filter("kind is not null and key is not null").filter(F.col("kind").isin(kinds))
    known = texts_with_ids(keyed)
    pairs, _ = similar_texts(known, kinds, length, threshold, least_words)
    links = pairs.select("kind", F.explode(F.array("id_a", "id_b")).alias("id")).groupBy("kind", "id").agg(F.count("*").alias("links"))
    firsts = known.groupBy("kind", "id").agg(F.min("key").alias("class_key"))
    ids = keyed.select("kind", "key", F.when(F.length("text") > 0, digest()).alias("id")).distinct()
    return (
        ids.join(firsts, ["kind", "id"], "left")
        .join(links, ["kind", "id"], "left")
        .select("kind", "key", "class_key", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    )
