"""String similarities of record pairs.

R(a, b) = 2 * L(a, b) / (|a| + |b|), L being the length of the longest common
subsequence of code points; 1 if both are empty. The other three are built on R.
Spark has no such function, so they run as Arrow-batched UDFs with a bit-parallel
L: one pass over a string with a whole row of the table in one integer. `ratios`
gives all six of a pair of records at once, each distinct pair of strings of a
batch computed one time; the functions on many pairs (`_all`) take a step of all of
them at once in machine words, and strings that don't fit go one by one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .text import words


def _masks(a: str) -> dict[str, int]:
    """The places of each character of a, as bits."""
    masks: dict[str, int] = {}
    for k, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << k
    return masks


def _common(masks: dict[str, int], n: int, b: str) -> int:
    full = (1 << n) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def lcs(a: str, b: str) -> int:
    return _common(_masks(a), len(a), b)


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 2 * lcs(a, b) / total if total else 1.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer one; windows
    are prefixes, full-length windows and suffixes, and both ways for equal lengths."""
    if not a or not b:
        return float(not a and not b)
    if len(a) == len(b):
        return max(_windows(a, b), _windows(b, a))
    return _windows(a, b) if len(a) < len(b) else _windows(b, a)


def _windows(short: str, long: str) -> float:
    m, n, masks = len(short), len(long), _masks(short)
    cuts = [(i, i + m) for i in range(n - m + 1)] + [(0, i) for i in range(m - 1, 0, -1)] + [(i, n) for i in range(n - m + 1, n)]
    best = 0.0
    for i, j in cuts:
        if 2 * (j - i) <= best * (m + j - i):
            continue  # not even if all of the window is common
        best = max(best, 2 * _common(masks, m, long[i:j]) / (m + j - i))
        if best == 1.0:
            break
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both, only_a, only_b = left & right, left - right, right - left
    if both and not (only_a and only_b):
        return 1.0
    x, y, common = (" ".join(sorted(s)) for s in (only_a, only_b, both))
    return _set_ratio(x, y, common, lcs(x, y))


def _set_ratio(x: str, y: str, common: str, same: int) -> float:
    """Of the words of one side, of the other and of both; same: the lcs of x and y."""
    gap = 1 if common else 0
    p, q = len(common) + gap + len(x), len(common) + gap + len(y)
    found = [1 - (len(x) + len(y) - 2 * same) / (p + q)]
    if common:
        found += [1 - (gap + len(x)) / (len(common) + p), 1 - (gap + len(y)) / (len(common) + q)]
    return max(found)


def _column(f):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


ratio_of, partial_ratio_of = _column(ratio), _column(partial_ratio)
token_sort_ratio_of, token_set_ratio_of = _column(token_sort_ratio), _column(token_set_ratio)


#: The longest string whose bits fit a machine word; pairs scored at a time.
BITS, PAIRS = 64, 1 << 12


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Code points, a row for each text, 0 after its end."""
    rows = np.array(texts, dtype=f"<U{max(1, width)}")
    return rows.view(np.uint32).reshape(len(texts), -1)


def _hits(a: np.ndarray, sizes: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """For each place of b the places of a with its character, as bits; none behind a's end."""
    inside = np.arange(a.shape[1]) < sizes[:, None]
    found = []
    for k in range(b.shape[1]):
        bits = np.packbits((a == b[:, k : k + 1]) & inside, axis=1, bitorder="little")
        word = np.zeros((len(a), 8), dtype=np.uint8)
        word[:, : bits.shape[1]] = bits
        found.append(word.view("<u8")[:, 0])
    return found


def _advance(row: np.ndarray, hits: np.ndarray) -> np.ndarray:
    hit = row & hits
    return (row + hit) | (row - hit)


def _full(sizes: np.ndarray) -> np.ndarray:
    """As many low bits as sizes say."""
    return np.where(sizes > 0, ~np.uint64(0) >> np.uint64(64) - np.maximum(sizes, 1).astype(np.uint64), np.uint64(0))


def _short_lcs(a: list[str], b: list[str]) -> np.ndarray:
    n, m = (np.array([len(v) for v in side]) for side in (a, b))
    codes_a, codes_b = _codes(a, int(n.max())), _codes(b, int(m.max()))
    full = _full(n)
    row = full.copy()
    for k, hits in enumerate(_hits(codes_a, n, codes_b)):
        row = np.where(k < m, _advance(row, hits), row)
    return n - np.bitwise_count(row & full)


def lcs_all(a: list[str], b: list[str]) -> np.ndarray:
    """`lcs` of many pairs; those of which the first is longer than a word one by one."""
    out = np.zeros(len(a), dtype=np.int64)
    short = np.array([0 < len(x) <= BITS and 0 < len(y) <= 4 * BITS for x, y in zip(a, b)], dtype=bool)
    for k in np.flatnonzero(~short):
        out[k] = lcs(a[k], b[k])
    places = np.flatnonzero(short)
    places = places[np.argsort([len(b[k]) for k in places], kind="stable")]
    for first in range(0, len(places), PAIRS):
        some = places[first : first + PAIRS]
        out[some] = _short_lcs([a[k] for k in some], [b[k] for k in some])
    return out


def ratio_all(a: list[str], b: list[str]) -> np.ndarray:
    total = np.array([len(x) + len(y) for x, y in zip(a, b)], dtype=np.int64)
    return np.where(total > 0, 2 * lcs_all(a, b) / np.maximum(total, 1), 1.0)


def _short_windows(short: list[str], long: list[str]) -> np.ndarray:
    """`_windows` of pairs whose strings are at most BITS long. One pass over the long string
    gives all prefixes, one from behind all suffixes; full-length windows have one each."""
    m, n = (np.array([len(v) for v in side]) for side in (short, long))
    width, most = int(m.max()), int(n.max())
    full, best = _full(m), np.zeros(len(m))

    def better(row, size, of):
        common = m - np.bitwise_count(row & full)
        np.maximum(best, np.where(of, 2 * common / (m + size), 0.0), out=best)

    codes = _codes(short, width), _codes(long, most)
    forward = _hits(codes[0], m, codes[1])
    row = full.copy()
    for k in range(most):
        row = _advance(row, forward[k])
        better(row, k + 1, k < m)
    row = full.copy()
    for k, hits in enumerate(_hits(_codes([v[::-1] for v in short], width), m, _codes([v[::-1] for v in long], most))):
        row = _advance(row, hits)
        better(row, k + 1, k < m)
    for first in range(1, int((n - m).max())):  # the first and the last one are done
        some = np.flatnonzero(first < n - m)
        row, size = full[some], m[some]
        for k in range(int(size.max())):
            row = np.where(k < size, _advance(row, forward[first + k][some]), row) if first + k < most else row
        best[some] = np.maximum(best[some], 2 * (size - np.bitwise_count(row & full[some])) / (2 * size))
    return best


def partial_ratio_all(a: list[str], b: list[str]) -> np.ndarray:
    """`partial_ratio` of many pairs; those with a string longer than a word one by one."""
    out = np.zeros(len(a))
    short = np.array([0 < len(x) <= BITS and 0 < len(y) <= BITS for x, y in zip(a, b)], dtype=bool)
    for k in np.flatnonzero(~short):
        out[k] = partial_ratio(a[k], b[k])
    places = np.flatnonzero(short)
    places = places[np.argsort([max(len(a[k]), len(b[k])) for k in places], kind="stable")]
    for first in range(0, len(places), PAIRS):
        some = places[first : first + PAIRS]
        sides = [sorted((a[k], b[k]), key=len) for k in some]
        out[some] = _short_windows([s for s, _ in sides], [t for _, t in sides])
        equal = np.array([len(s) == len(t) for s, t in sides])
        if equal.any():
            same = [pair for pair, one in zip(sides, equal) if one]
            out[some[equal]] = np.maximum(out[some[equal]], _short_windows([t for _, t in same], [s for s, _ in same]))
    return out


def token_sort_ratio_all(a: list[str], b: list[str]) -> np.ndarray:
    return ratio_all(*([" ".join(sorted(v.split())) for v in side] for side in (a, b)))


def token_set_ratio_all(a: list[str], b: list[str]) -> np.ndarray:
    """`token_set_ratio` of many pairs: the words that only one side has are compared together."""
    out, rest = np.zeros(len(a)), []
    for k, (x, y) in enumerate(zip(a, b)):
        left, right = set(x.split()), set(y.split())
        if not left or not right:
            continue
        both, only_a, only_b = left & right, left - right, right - left
        if both and not (only_a and only_b):
            out[k] = 1.0
        else:
            rest.append((k, *(" ".join(sorted(s)) for s in (only_a, only_b, both))))
    if rest:
        for (k, x, y, common), same in zip(rest, lcs_all([r[1] for r in rest], [r[2] for r in rest]).tolist()):
            out[k] = _set_ratio(x, y, common, same)
    return out


NAME_RATIOS, ADDRESS_RATIOS = (ratio_all, partial_ratio_all, token_sort_ratio_all, token_set_ratio_all), (ratio_all, token_sort_ratio_all)


RATIOS = ("name_ratio", "name_partial_ratio", "name_token_sort_ratio", "name_token_set_ratio", "addr_ratio", "addr_token_sort_ratio")


@F.pandas_udf(StructType([StructField(name, DoubleType()) for name in RATIOS]))
def ratios(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
    """The four of two names and the two of two addresses, as a struct."""
    columns = []
    for functions, left, right in ((NAME_RATIOS, a, b), (ADDRESS_RATIOS, x, y)):
        places: dict[tuple[str, str], int] = {}
        at = [places.setdefault(pair, len(places)) for pair in zip(left, right)]
        one, two = [p for p, _ in places], [q for _, q in places]
        columns += [f(one, two)[at] for f in functions]
    return pd.DataFrame(dict(zip(RATIOS, columns)), columns=list(RATIOS), dtype="float64")


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of lower-cased words: both empty 1, one empty or null 0."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    value = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)).cast("double")
    return (
        F.when(a.isNull() | b.isNull(), 0.0)
        .when((F.size(x) == 0) & (F.size(y) == 0), 1.0)
        .when((F.size(x) == 0) | (F.size(y) == 0), 0.0)
        .otherwise(value)
    )
