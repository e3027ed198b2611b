"""Parameter sweeps: one configuration after the other, measured and judged against one truth."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame

from nearfield.functions.families import CrossPolytope, JL, MinHash, OneBitMinHash, SimHash
from nearfield.operators.evaluate import evaluate
from nearfield.operators.preprocess import minhash_ready
from nearfield.operators.search import LshIndex, exact_knn, sketch_knn
from nearfield.sources.metrics import FIELDS


@dataclass(frozen=True)
class Run:
    """One experiment.  implementation: 2 exact, 3 SimHash, 4 MinHash, 5 one-bit MinHash, 6 projection;
    key_implementation: 0 for a scan, or 3, 4, 5, 7 (cross-polytope) for hash tables."""

    implementation: int
    k: int
    key_implementation: int = 0
    sketch_dim: int = 4
    candidates: int = 100
    bits: int = 4
    tables: int = 8
    metric: str | None = None
    seed: int = 42


def make_family(code: int, groups: int, bits: int, dim: int, bounds: list[int] | None, seed: int):
    makers = {
        3: lambda: SimHash(dim, groups, bits, seed),
        4: lambda: MinHash(bounds, groups, seed),
        5: lambda: OneBitMinHash(bounds, groups, seed, bits=bits),
        6: lambda: JL(dim, groups, seed),
        7: lambda: CrossPolytope(dim, groups, seed),
    }
    if code not in makers:
        raise ValueError(f"no hash family has code {code}")
    return makers[code]()


def run_grid(data: DataFrame, queries: DataFrame, runs: list[Run], truths: dict[str, DataFrame] | None = None, dataset: str = "") -> DataFrame:
    """Records of the runs, in the metrics format; times in milliseconds of wall clock.

    Truths are computed once for each distance unless given.
    """
    spark, truths, rows = data.sparkSession, dict(truths or {}), []
    dim = len(data.first()["v"])
    ready = None
    for r in runs:
        codes = {r.implementation, r.key_implementation}
        d, q, bounds, t0 = data, queries, None, time.time()
        if codes & {4, 5}:
            if ready is None:
                a, b, bounds = minhash_ready(data, queries)
                ready = (a.persist(), b.persist(), bounds)
                ready[0].count(), ready[1].count()
            d, q, bounds = ready
        preprocess, t0 = time.time() - t0, time.time()
        sketch = None if r.implementation == 2 else make_family(r.implementation, r.sketch_dim, 32, dim, bounds, r.seed)
        construction = 0.0
        if r.key_implementation:
            index = LshIndex(make_family(r.key_implementation, r.tables, r.bits, dim, bounds, r.seed)).build(d)
            index.table = index.table.persist()
            index.table.count()
            construction, t0 = time.time() - t0, time.time()
            metric = r.metric or index.family.exact
            found = index.query(d, q, r.k, metric, sketch, r.candidates)
        elif sketch is None:
            metric = r.metric or "cosine"
            found = exact_knn(d, q, r.k, metric)
        else:
            metric = r.metric or sketch.exact
            found = sketch_knn(d, q, sketch, r.k, r.candidates, metric)
        found = found.persist()
        found.count()
        scan = time.time() - t0
        if metric not in truths:
            truths[metric] = exact_knn(data, queries, r.k, metric).persist()
        quality = evaluate(truths[metric], found, r.k).first()
        found.unpersist()
        rows.append((r.implementation, r.key_implementation, r.sketch_dim, r.k, 0, r.bits, r.tables if r.key_implementation else 0, 0, int(preprocess * 1000), int(construction * 1000), int(scan * 1000), quality["recall"], quality["ratio"], dataset))
    return spark.createDataFrame(rows, FIELDS)
