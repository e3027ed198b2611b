"""SQL text for DuckDB: the same plans over the same tables, random numbers written out."""

from __future__ import annotations

import numpy as np

from nearfield.functions.families import CrossPolytope, JL, MinHash, OneBitMinHash, SimHash

#: Vectors as 64-bit numbers; every tenth row is a query, the others are data.
VECTORS = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT * FROM e WHERE id % 10 = 0), d AS (SELECT * FROM e WHERE id % 10 <> 0)"

#: u: shifted to be non-negative, then of unit length; uq and ud: its queries and data.
READY = (
    VECTORS
    + ", parts AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e)"
    + ", shift AS (SELECT list(m ORDER BY pos) AS s FROM (SELECT pos, abs(least(0, min(floor(x)))) AS m FROM parts GROUP BY pos))"
    + ", moved AS (SELECT id, list_transform(range(1, len(v) + 1), lambda i: v[i] + s[i]) AS v FROM e, shift)"
    + ", u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM moved)"
    + ", uq AS (SELECT * FROM u WHERE id % 10 = 0), ud AS (SELECT * FROM u WHERE id % 10 <> 0)"
)

COS = "list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)))"
JACCARD = (
    "1 - list_sum(list_transform(range(1, len(a.v) + 1), lambda i: least(a.v[i], b.v[i])))"
    " / list_sum(list_transform(range(1, len(a.v) + 1), lambda i: greatest(a.v[i], b.v[i])))"
)
EXACT = {
    "cosine": f"1 - {COS}",
    "neg_cosine": f"-({COS})",
    "angular": f"acos(least(1.0, greatest(-1.0, {COS}))) / pi()",
    "euclidean": "list_distance(a.v, b.v)",
    "gen_jaccard": JACCARD,
}
DIFFERING = "list_sum(list_transform(range(1, len(a.s) + 1), lambda i: bit_count(xor(a.s[i], b.s[i]))))"
SKETCH = {
    "hamming": f"({DIFFERING})::DOUBLE",
    "one_bit": f"({DIFFERING}) / (32.0 * len(a.s))::DOUBLE",
    "match": "1 - list_sum(list_transform(range(1, len(a.s) + 1), lambda i: (a.s[i] = b.s[i])::INTEGER)) / len(a.s)::DOUBLE",
    "sq_euclidean": "list_sum(list_transform(range(1, len(a.s) + 1), lambda i: (a.s[i] - b.s[i]) * (a.s[i] - b.s[i])))",
}


def numbers(m: np.ndarray, kind: str) -> str:
    def row(r) -> str:
        return "[" + ",".join(f"{x:.6f}".rstrip("0").rstrip(".") if kind == "DOUBLE" else str(int(x)) for x in r) + "]"

    m = np.asarray(m)
    return f"{row(m)}::{kind}[]" if m.ndim == 1 else f"[{','.join(map(row, m))}]::{kind}[][]"


def hashed(family, source: str, name: str) -> str:
    """CTEs ending in ``name``(id, v, s): the family's outputs over the CTE ``source``."""
    if isinstance(family, SimHash):
        bit = f"CASE WHEN list_inner_product(v, p[w * {family.bits} + b + 1]) >= 0 THEN (1::BIGINT << b) ELSE 0 END"
        word = f"list_sum(list_transform(range(0, {family.bits}), lambda b: {bit}))::BIGINT"
        return f"{name}_r AS (SELECT {numbers(family.planes, 'DOUBLE')} AS p), {name} AS (SELECT id, v, list_transform(range(0, {family.groups}), lambda w: {word}) AS s FROM {source}, {name}_r)"
    if isinstance(family, JL):
        unit = "list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))"
        return f"{name}_r AS (SELECT {numbers(family.planes, 'DOUBLE')} AS p), {name} AS (SELECT id, v, list_transform(p, lambda r: list_inner_product(n, r)) AS s FROM (SELECT id, v, {unit} AS n FROM {source}), {name}_r)"
    if isinstance(family, CrossPolytope):
        size = family.matrices.shape[1]
        flat = family.matrices.reshape(-1, family.matrices.shape[2])
        y = f"list_transform(range(1, {len(flat) + 1}), lambda r: list_inner_product(v, p[r]))"
        at = f"list_position(list_transform(list_slice(y, t * {size} + 1, (t + 1) * {size}), lambda x: abs(x)), list_max(list_transform(list_slice(y, t * {size} + 1, (t + 1) * {size}), lambda x: abs(x))))"
        key = f"(CASE WHEN y[t * {size} + {at}] < 0 THEN {at} - 1 ELSE {at} - 1 + {size} END)::BIGINT"
        return f"{name}_r AS (SELECT {numbers(flat, 'DOUBLE')} AS p), {name}_y AS (SELECT id, v, {y} AS y FROM {source}, {name}_r), {name} AS (SELECT id, v, list_transform(range(0, {family.groups}), lambda t: {key}) AS s FROM {name}_y)"
    if isinstance(family, MinHash):
        streams = f"{name}_r AS (SELECT {numbers(family.component + 1, 'INTEGER')} AS c, {numbers(family.height, 'DOUBLE')} AS h)"
        green = "list_position(list_transform(range(1, len(c[k]) + 1), lambda t: v[c[k][t]] >= h[k][t]), true)"
        values = f"list_transform(range(1, {family.streams() + 1}), lambda k: coalesce(nullif({green}, 0) - 1, {family.draws})::BIGINT)"
        if not isinstance(family, OneBitMinHash):
            return f"{streams}, {name} AS (SELECT id, v, {values} AS s FROM {source}, {name}_r)"
        word = f"list_sum(list_transform(range(0, {family.bits}), lambda b: (m[o[w * {family.bits} + b + 1] + 1]::BIGINT << b)))::BIGINT"
        return (
            f"{streams}, {name}_o AS (SELECT id, v, {values} AS o FROM {source}, {name}_r), {name}_m AS (SELECT {numbers(family.bitmap, 'INTEGER')} AS m),"
            f" {name} AS (SELECT id, v, list_transform(range(0, {family.groups}), lambda w: {word}) AS s FROM {name}_o, {name}_m)"
        )
    raise ValueError(type(family).__name__)


def pairs(a: str, b: str, dist: str, where: str = "true") -> str:
    return f"SELECT a.id AS q_id, b.id AS d_id, {dist} AS dist FROM {a} a, {b} b WHERE {where}"


def top(source: str, k: int) -> str:
    """(q_id, rank, d_id, dist), unrounded."""
    return f"SELECT q_id, (row_number() OVER (PARTITION BY q_id ORDER BY dist, d_id))::INTEGER AS rank, d_id, dist FROM ({source}) WHERE dist IS NOT NULL AND NOT isnan(dist) QUALIFY rank <= {k}"


def rounded(source: str) -> str:
    return f"SELECT q_id, rank, d_id, round(dist, 6) + 0.0 AS dist FROM ({source})"


def exact(metric: str, k: int) -> tuple[str, str]:
    """(CTEs, selection of the unrounded neighbours)"""
    ready = metric == "gen_jaccard"
    return (READY if ready else VECTORS), top(pairs("uq" if ready else "q", "ud" if ready else "d", EXACT[metric]), k)


def sketch_top(family, c: int) -> tuple[str, str]:
    ready = isinstance(family, MinHash)
    ctes = (READY if ready else VECTORS) + ", " + hashed(family, "u" if ready else "e", "hs")
    return ctes, top(pairs("hs", "hs", SKETCH[family.metric], "a.id % 10 = 0 AND b.id % 10 <> 0"), c)


def sketch_search(family, k: int, c: int) -> tuple[str, str]:
    ctes, first = sketch_top(family, c)
    ready = isinstance(family, MinHash)
    a, b = ("uq", "ud") if ready else ("q", "d")
    return f"{ctes}, cand AS ({first})", top(f"SELECT c.q_id, c.d_id, {EXACT[family.exact]} AS dist FROM cand c JOIN {a} a ON a.id = c.q_id JOIN {b} b ON b.id = c.d_id", k)


def lsh(family) -> str:
    """CTEs with idx(table_id, bucket_key, id) over all vectors, and cand(q_id, d_id)."""
    ready = isinstance(family, MinHash)
    return (
        (READY if ready else VECTORS)
        + ", "
        + hashed(family, "u" if ready else "e", "hk")
        + ", idx AS (SELECT id, unnest(s) AS bucket_key, (generate_subscripts(s, 1) - 1)::INTEGER AS table_id FROM hk)"
        + ", cand AS (SELECT DISTINCT a.id AS q_id, b.id AS d_id FROM idx a JOIN idx b ON a.table_id = b.table_id AND a.bucket_key = b.bucket_key WHERE a.id % 10 = 0 AND b.id % 10 <> 0)"
    )


def lsh_search(family, k: int, sketch=None, c: int = 100) -> tuple[str, str]:
    ready = isinstance(family, MinHash)
    ctes, cand = lsh(family), "cand"
    if sketch is not None:
        by_sketch = f"SELECT c.q_id, c.d_id, {SKETCH[sketch.metric]} AS dist FROM cand c JOIN hs a ON a.id = c.q_id JOIN hs b ON b.id = c.d_id"
        ctes += ", " + hashed(sketch, "u" if ready else "e", "hs") + f", best AS ({top(by_sketch, c)})"
        cand = "best"
    a, b = ("uq", "ud") if ready else ("q", "d")
    return ctes, top(f"SELECT c.q_id, c.d_id, {EXACT[family.exact]} AS dist FROM {cand} c JOIN {a} a ON a.id = c.q_id JOIN {b} b ON b.id = c.d_id", k)
