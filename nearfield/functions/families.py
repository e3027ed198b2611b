"""Hash families over vectors: SimHash, Johnson-Lindenstrauss, cross-polytope, weighted and one-bit MinHash.

A family draws its random numbers once from a seed and maps a matrix of rows to
a matrix of words, hash values or projections.  The same object serves as a
sketch (``groups`` outputs of a vector) and as bucket keys (``groups`` tables).
Random numbers are rounded to six decimals, so that they can be written out.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

#: Draws of a MinHash stream; a vector that accepts none of them hashes to this number.
DRAWS = 256


def gaussian(shape: tuple[int, ...], seed: int, scale: float = 1.0) -> np.ndarray:
    return np.round(np.random.default_rng(seed).standard_normal(shape) * scale, 6)


def signs(shape: tuple[int, ...], seed: int, p_negative: float = 0.5) -> np.ndarray:
    return np.where(np.random.default_rng(seed).random(shape) < p_negative, -1.0, 1.0)


def fair_bits(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2, n)


def next_power_of_two(n: int) -> int:
    return 1 << max(0, int(n - 1).bit_length())


def packed(bits: np.ndarray) -> np.ndarray:
    """(rows, groups, bits) of 0/1 to (rows, groups) words, the first bit lowest."""
    return (bits.astype(np.int64) << np.arange(bits.shape[2])).sum(2)


@dataclass
class SimHash:
    dim: int
    groups: int
    bits: int = 32
    seed: int = 42
    planes: np.ndarray = field(init=False, repr=False)
    as_key, as_sketch, unit, metric, exact = True, True, False, "hamming", "cosine"
    #: Outputs of a vector that is null: no bit is set.
    of_null = 0

    def __post_init__(self):
        self.planes = gaussian((self.groups * self.bits, self.dim), self.seed)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        # Not below zero: as SQL orders numbers, nan is above all.
        return packed((~(x @ self.planes.T < 0)).reshape(len(x), self.groups, self.bits))


@dataclass
class JL:
    dim: int
    groups: int
    seed: int = 43
    planes: np.ndarray = field(init=False, repr=False)
    as_key, as_sketch, unit, metric, exact = False, True, True, "sq_euclidean", "cosine"

    def __post_init__(self):
        self.planes = gaussian((self.groups, self.dim), self.seed, 1 / np.sqrt(self.groups))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.planes.T


@dataclass
class CrossPolytope:
    """Three rounds of sign flips and Walsh-Hadamard transforms; the key names the largest coordinate and its sign."""

    dim: int
    groups: int
    seed: int = 44
    p_negative: float = 0.5
    matrices: np.ndarray = field(init=False, repr=False)
    as_key, as_sketch, unit, metric, exact = True, False, True, None, "cosine"

    def __post_init__(self):
        p = next_power_of_two(self.dim)
        hadamard = np.ones((1, 1))
        while len(hadamard) < p:
            hadamard = np.block([[hadamard, hadamard], [hadamard, -hadamard]])
        flips = signs((self.groups, 3, p), self.seed, self.p_negative)
        self.matrices = np.stack([hadamard * f[2] @ (hadamard * f[1]) @ (hadamard * f[0]) for f in flips])[:, :, : self.dim]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = np.einsum("tpd,nd->ntp", self.matrices, x)
        at = np.abs(y).argmax(2)
        return np.where(np.take_along_axis(y, at[:, :, None], 2)[:, :, 0] < 0, at, at + self.matrices.shape[1])


@dataclass
class MinHash:
    """Weighted MinHash by rejection: the number of draws before one falls under the vector's outline.

    bounds: an upper bound of each component (whole numbers).  A draw names a
    component and a height; it is accepted where the height is at most the component.
    """

    bounds: Sequence[int]
    groups: int
    seed: int = 45
    draws: int = DRAWS
    component: np.ndarray = field(init=False, repr=False)
    height: np.ndarray = field(init=False, repr=False)
    as_key, as_sketch, unit, metric, exact = True, True, True, "match", "gen_jaccard"

    def streams(self) -> int:
        return self.groups

    def __post_init__(self):
        bounds = np.asarray(self.bounds, np.int64)
        if not bounds.any():  # an empty table has no components, and nothing is drawn
            self.component, self.height = np.zeros((self.streams(), self.draws), np.int64), np.full((self.streams(), self.draws), np.inf)
            return
        r = np.round(np.random.default_rng(self.seed).random((self.streams(), self.draws)) * bounds.sum(), 6)
        r = np.minimum(r, bounds.sum() - 1e-6)
        slot = np.repeat(np.arange(len(bounds)), bounds)
        self.component = slot[np.floor(r).astype(np.int64)]
        self.height = np.round(r - (np.cumsum(bounds) - bounds)[self.component], 6)

    def values(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), self.streams()), np.int64)
        rows = max(1, 2_000_000 // self.component.size)
        for k in range(0, len(x), rows):
            green = x[k : k + rows][:, self.component] >= self.height
            out[k : k + rows] = np.where(green.any(2), green.argmax(2), self.draws)
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.values(x)


@dataclass
class OneBitMinHash(MinHash):
    """One fair bit of each MinHash value, packed into words."""

    bits: int = 32
    bitmap_seed: int = 46
    metric = "one_bit"

    def streams(self) -> int:
        return self.groups * self.bits

    def __post_init__(self):
        super().__post_init__()
        self.bitmap = fair_bits(self.draws + 1, self.bitmap_seed)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return packed(self.bitmap[self.values(x)].reshape(len(x), self.groups, self.bits))


def check_role(family, role: str) -> None:
    """role: ``key`` or ``sketch``; projections are no keys, cross-polytope hashes no sketches."""
    if not getattr(family, f"as_{role}"):
        raise ValueError(f"{type(family).__name__} cannot serve as a {role}")


def matrix(column: pa.Array, dim: int | None = None, kind=np.float64) -> np.ndarray:
    """A list column as a matrix; rows of other lengths are an error."""
    if not len(column):
        return np.zeros((0, dim or 1), kind)
    sizes = np.diff(np.asarray(column.offsets))
    width = dim or int(sizes[0])
    if (sizes != width).any():
        raise ValueError(f"vectors of {sorted(set(sizes.tolist()))} components where {width} are wanted")
    return np.asarray(column.flatten(), kind).reshape(len(column), width)


def with_hash(df: DataFrame, family, name: str) -> DataFrame:
    """``df(.., v)`` with the family's outputs as an array column; a null vector is an error unless the family has outputs for it."""
    real = isinstance(family, JL)
    item = "double" if real else "long"
    # By value: executors may not have the repository on their path.
    sent = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(family))

    def run(batches):
        known = pickle.loads(sent.value)
        for b in batches:
            v, of_null = b.column(b.schema.get_field_index("v")), getattr(known, "of_null", None)
            there = v.is_valid().to_numpy(zero_copy_only=False) if of_null is not None else np.ones(len(v), bool)
            x = matrix(v if there.all() else v.drop_null(), getattr(known, "dim", None) or len(known.bounds))
            if family_unit:
                length = np.sqrt((x * x).sum(1, keepdims=True))
                x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
            out = known(x)
            if not there.all():
                all_rows = np.full((len(v), known.groups), of_null, out.dtype)
                all_rows[there] = out
                out = all_rows
            kind = pa.list_(pa.float64() if real else pa.int64())
            yield pa.RecordBatch.from_pydict(dict(zip(b.schema.names, b.columns, strict=True)) | {name: pa.array(list(out), kind)})

    family_unit = family.unit and not isinstance(family, MinHash)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, `{name}` array<{item}>")
