"""Exact and sketch distances: as Columns over two arrays, and as numpy kernels over blocks.

A kernel takes the queries' matrix and the data's, and returns the matrix of
distances; nan stands for "no distance" (a zero vector has no angle).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield.functions import vectors as V

#: Codes of the exact distances.
CODES = {1: "cosine", 2: "gen_jaccard", 3: "euclidean"}
#: Codes of the sketch distances.
SKETCH_CODES = {3: "hamming", 4: "match", 5: "one_bit", 6: "sq_euclidean"}
WORD_BITS = 32
#: Rows that a query is compared with at once, so that they stay in a processor's cache.
CACHED = 1_024
#: Sums between which single precision keeps its relative accuracy, however they are made up.
SINGLE = (1e-20, 1e20)


def _cos(a: Column, b: Column) -> Column:
    return F.try_divide(V.dot(a, b), V.norm(a) * V.norm(b))


def _differing(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)


COLUMNS: dict[str, Callable[[Column, Column], Column]] = {
    "cosine": lambda a, b: 1 - _cos(a, b),
    "neg_cosine": lambda a, b: -_cos(a, b),
    "angular": lambda a, b: F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), _cos(a, b)))) / F.pi(),
    "euclidean": lambda a, b: F.sqrt(V.total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))),
    "gen_jaccard": lambda a, b: 1 - F.try_divide(V.total(F.zip_with(a, b, lambda x, y: F.least(x, y))), V.total(F.zip_with(a, b, lambda x, y: F.greatest(x, y)))),
    "sq_euclidean": lambda a, b: V.total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))),
    "hamming": lambda a, b: _differing(a, b).cast("double"),
    "one_bit": lambda a, b: _differing(a, b) / (F.size(a) * WORD_BITS),
    "match": lambda a, b: 1 - F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x) / F.size(a),
}


def distance(metric: str | int, a: Column, b: Column) -> Column:
    """The distance of two array columns, by name or by exact-distance code."""
    name = CODES.get(metric, metric)
    if name not in COLUMNS:
        raise ValueError(f"unknown distance: {metric!r}")
    return COLUMNS[name](a, b)


def sketch_distance(code: int, a: Column, b: Column) -> Column:
    """The distance of two sketch columns by the method's code: 3 SimHash, 4 MinHash, 5 one-bit MinHash, 6 projection."""
    if code not in SKETCH_CODES:
        raise ValueError(f"no sketch has code {code!r}")
    return COLUMNS[SKETCH_CODES[code]](a, b)


def _np_cos(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    length = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(length > 0, (q @ x.T) / length, np.nan)


def _np_square(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T, 0)


def _single(*sums: np.ndarray) -> bool:
    """Whether sums over vectors without negative components are safe in single precision: zero, or far from its limits."""
    return all(bool(((s == 0) | ((s > SINGLE[0]) & (s < SINGLE[1]))).all()) for s in sums)


def _smaller(q: np.ndarray, x: np.ndarray, kind) -> np.ndarray:
    """Sums of the smaller components, of every query with every row, a few rows at once."""
    out, ones, held = np.empty((len(q), len(x)), kind), np.ones(q.shape[1], kind), np.empty((CACHED, q.shape[1]), kind)
    q = q.astype(kind)
    for s in range(0, len(x), CACHED):
        rows = x[s : s + CACHED].astype(kind)
        least = held[: len(rows)]
        for i, row in enumerate(q):
            np.dot(np.minimum(rows, row, out=least), ones, out=out[i, s : s + CACHED])
    return out


def _np_jaccard(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    sums = q.sum(1), x.sum(1)
    plain = not ((q < 0).any() or (x < 0).any()) and _single(*sums)
    low = _smaller(q, x, np.float32 if plain else np.float64)
    out = sums[0][:, None] + sums[1][None, :]
    out -= low
    none = out == 0
    with np.errstate(divide="ignore", invalid="ignore"):
        np.divide(low, out, out=out)
    np.subtract(1, out, out=out)
    out[none] = np.nan
    return out


def _np_differing(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(x)))
    for w in range(q.shape[1]):
        out += np.bitwise_count(q[:, w][:, None] ^ x[:, w][None, :])
    return out


def _np_match(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    same = np.zeros((len(q), len(x)))
    for w in range(q.shape[1]):
        same += q[:, w][:, None] == x[:, w][None, :]
    return 1 - same / q.shape[1]


KERNELS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "cosine": lambda q, x: 1 - _np_cos(q, x),
    "neg_cosine": lambda q, x: -_np_cos(q, x),
    "angular": lambda q, x: np.arccos(np.clip(_np_cos(q, x), -1, 1)) / np.pi,
    "euclidean": lambda q, x: np.sqrt(_np_square(q, x)),
    "gen_jaccard": _np_jaccard,
    "sq_euclidean": _np_square,
    "hamming": _np_differing,
    "one_bit": lambda q, x: _np_differing(q, x) / (q.shape[1] * WORD_BITS),
    "match": _np_match,
}


def _row_cos(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    length = np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(length > 0, (x * q).sum(1) / length, np.nan)


def _row_jaccard(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    high = np.maximum(x, q).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(high != 0, 1 - np.minimum(x, q).sum(1) / high, np.nan)


#: One query against rows, summed row by row: equal rows get equal distances, whatever block they come in.
ROWS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "cosine": lambda q, x: 1 - _row_cos(q, x),
    "neg_cosine": lambda q, x: -_row_cos(q, x),
    "angular": lambda q, x: np.arccos(np.clip(_row_cos(q, x), -1, 1)) / np.pi,
    "euclidean": lambda q, x: np.sqrt(((x - q) ** 2).sum(1)),
    "gen_jaccard": _row_jaccard,
    "sq_euclidean": lambda q, x: ((x - q) ** 2).sum(1),
}
#: Kernels and row sums differ by less than this, for vectors of length one, ...
SLACK = 1e-6
#: ... and by this much more a component where a kernel counts in single precision: four roundings.
SLACK_A_COMPONENT = {"gen_jaccard": 2.0**-22}
#: Distances over whole numbers (sketch words and hash values).
INTEGER = {"hamming", "one_bit", "match"}
