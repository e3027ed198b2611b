"""Toxicity: a linear classifier from confirmed toxic and unlabelled text, by non-negative PU learning.

The risk of the negative class is estimated as that of all text minus the class
prior times that of the toxic examples; where it falls below zero it counts as zero.  Features
are words and beginnings of words (present in a text or not) that are clearly more
frequent in the toxic examples; they are counted and chosen on the executors, and a numpy
model is fitted on the driver from bounded samples.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import WORD_MEMORY, column_bytes, scratch, sent, small_batches, staged, table_batch, tidy, without
from nearfield.llm.decontam import FOLD

#: Most toxic and most unlabelled texts that the fit reads, chosen by hash.
MOST_POSITIVE, MOST_UNLABELLED = 8_000, 16_000
MOST_FEATURES = 512
LEAST_Z = 5.0
#: Lengths in bytes of the beginnings of words that count as features, beside whole words.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: Cells in which the sample's features are counted first, and parts of them that are added up apart.
CELL_BITS, CELL_PARTS = 20, 64
#: Tasks that read the sample.
FIT_TASKS = 24


@dataclass
class Model:
    words: np.ndarray  # hashes of the features, sorted
    weights: np.ndarray
    bias: float


def risk_and_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative PU risk under the logistic loss, and its gradient; the last weight is the bias.

    prior * E_p[loss as toxic] + max(0, E_u[loss as not toxic] - prior * E_p[loss as not toxic])
    """
    sigmoid = lambda z: 0.5 * (1 + np.tanh(z / 2))
    softplus = lambda z: np.logaddexp(0, z)
    grad = lambda x, d: np.append(x.T @ d, d.sum()) / len(d)
    zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
    risk, g = prior * softplus(-zp).mean(), prior * grad(p, -sigmoid(-zp))
    negative = softplus(zu).mean() - prior * softplus(zp).mean()
    if negative >= 0:
        risk, g = risk + negative, g + grad(u, sigmoid(zu)) - prior * grad(p, sigmoid(zp))
    return float(risk), g


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 60, rate: float = 0.05, decay: float = 1e-4, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias that lower the non-negative PU risk (Adam, mini-batches)."""
    rng = np.random.default_rng(seed)
    w = np.zeros(positive.shape[1] + 1)
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    batches = max(1, len(unlabelled) // 2000)
    for _ in range(epochs):
        ps, us = np.array_split(rng.permutation(len(positive)), batches), np.array_split(rng.permutation(len(unlabelled)), batches)
        for p_rows, u_rows in zip(ps, us, strict=True):
            if not len(p_rows):
                p_rows = np.arange(len(positive))
            g = risk_and_gradient(w, positive[p_rows].astype(np.float64), unlabelled[u_rows].astype(np.float64), prior)[1]
            g[:-1] += decay * w[:-1]
            t += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


class Features(dict):
    """Hashes of a word and of its beginnings, computed once per word and task."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= WORD_MEMORY // 4:
            self.clear()
        parts = [word] + [word[:k] + b"*" for k in BEGINNINGS if len(word) > k]
        value = self[word] = tuple(map(xxhash.xxh3_64_intdigest, parts))
        return value


def words_in(text: bytes | None) -> set[bytes]:
    return set((text or b"").translate(FOLD).split())


def _cell_counts(batches):
    """How many texts of each kind hold a feature of each cell, by parts of the cells."""
    features, counts = Features(), {True: np.zeros(1 << CELL_BITS, np.uint32), False: np.zeros(1 << CELL_BITS, np.uint32)}
    for batch in batches:
        for text, kind in zip(column_bytes(batch, "text"), batch.column(batch.schema.get_field_index("positive")).to_pylist(), strict=True):
            own = {h & ((1 << CELL_BITS) - 1) for w in words_in(text) for h in features[w]}
            counts[kind][np.fromiter(own, np.int64, len(own))] += 1
    schema = pa.schema([("part", pa.int32()), ("positive", pa.bool_()), ("cells", pa.binary()), ("counts", pa.binary())])
    step = (1 << CELL_BITS) // CELL_PARTS
    for kind, c in counts.items():
        for part in range(CELL_PARTS):
            own = c[part * step : (part + 1) * step]
            cells = np.flatnonzero(own)
            if len(cells):
                yield table_batch(schema, part=[part], positive=[kind], cells=[cells.astype(np.uint32).tobytes()], counts=[own[cells].tobytes()])


def z_scores(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """How much more often p of n_p than u of n_u: two shares compared."""
    rate_p, rate_u = (p + 0.5) / (n_p + 1), (u + 0.5) / (n_u + 1)
    both = (p + u + 1) / (n_p + n_u + 2)
    return (rate_p - rate_u) / np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u))


def _telling_cells(n_p: int, n_u: int):
    """The cells of a part that tell toxic examples from other text, the clearest first."""

    def run(table: pa.Table) -> pa.Table:
        step = (1 << CELL_BITS) // CELL_PARTS
        count = {True: np.zeros(step, np.int64), False: np.zeros(step, np.int64)}
        for kind, cells, counts in zip(*(table.column(k).to_pylist() for k in ("positive", "cells", "counts")), strict=True):
            count[kind][np.frombuffer(cells, np.uint32)] += np.frombuffer(counts, np.uint32)
        z = z_scores(count[True], count[False], n_p, n_u)
        cells = np.flatnonzero((z >= LEAST_Z) & (count[True] >= 3))
        cells = cells[np.argsort(-z[cells], kind="stable")[:MOST_FEATURES]]
        return pa.table({"cell": pa.array(cells + table.column("part")[0].as_py() * step, pa.int64()), "z": pa.array(z[cells]), "n": pa.array(count[True][cells], pa.int64())})

    return run


def _in_cells(cells):
    schema = pa.schema([("feature", pa.int64())])

    def run(batches):
        features, wanted = Features(), set(cells.value.tolist())
        for batch in batches:
            for text in column_bytes(batch, "text"):
                own = {h for w in words_in(text) for h in features[w] if h & ((1 << CELL_BITS) - 1) in wanted}
                yield table_batch(schema, feature=np.fromiter(own, np.uint64, len(own)).astype(np.int64))

    return run


def _present(chosen):
    schema = pa.schema([("positive", pa.bool_()), ("at", pa.list_(pa.int32()))])

    def run(batches):
        features, place = Features(), {int(h): i for i, h in enumerate(chosen.value)}
        for batch in batches:
            out = [sorted({place[h] for w in words_in(text) for h in features[w] if h in place}) for text in column_bytes(batch, "text")]
            yield table_batch(schema, positive=batch.column(batch.schema.get_field_index("positive")).to_pylist(), at=out)

    return run


def train(docs: DataFrame, toxic: DataFrame, train_fold: Column) -> Model | None:
    """Fits on the rows of ``docs`` in the training fold; toxic: (doc_id, toxic 0/1), may cover part of them.

    Only label 1 is read as an example; label 0 counts in the class prior alone.
    Where fewer than three toxic examples share a feature, or none tells them from
    other text, the model has no features: every text scores the class prior.
    None where nothing is labelled.  Null texts count as empty, very long ones are
    read whole; rows with equal ids each count.
    """
    spark = docs.sparkSession
    small_batches(spark)
    labels = toxic.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pool = docs.select("doc_id", "text").where(train_fold)
    marked = labels.where(train_fold)
    counts = marked.agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).first()
    if not counts["n"]:
        return None
    prior = min(0.5, max(0.005, counts["p"] / counts["n"]))
    flat = Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    if not counts["p"]:
        return flat
    with scratch(spark):
        ids = marked.where("toxic = 1").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(MOST_POSITIVE).select("doc_id")
        positive = pool.join(F.broadcast(ids), "doc_id", "left_semi").select("text", F.lit(True).alias("positive"))
        # The sample's threshold comes from the ids alone, so no text is sorted.
        total = pool.agg(F.count("*")).first()[0]
        cut = int((min(1.0, MOST_UNLABELLED / max(1, total)) - 0.5) * 2.0**64)
        unlabelled = pool.where(F.xxhash64("doc_id", F.lit(12)) <= F.lit(max(-(2**63), min(2**63 - 1, cut)))).select("text", F.lit(False).alias("positive"))
        # One parallel job reads the table; the fit reads the sample in few parts.
        sample = staged(positive.unionByName(unlabelled).repartition(FIT_TASKS))
        n = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
        if len(n) < 2:
            return flat
        found = sample.mapInArrow(tidy(_cell_counts), "part int, positive boolean, cells binary, counts binary").groupBy("part").applyInArrow(_telling_cells(n[True], n[False]), "cell long, z double, n long")
        top = found.orderBy(F.desc("z"), "cell").limit(MOST_FEATURES).collect()
        if not top:
            return flat
        cells = {r["cell"]: r["n"] for r in top}
        held = sample.where("positive").mapInArrow(_in_cells(spark.sparkContext.broadcast(np.array(list(cells)))), "feature long").groupBy("feature").count()
        # Of the features of a cell, those that make up a good part of its count.
        rows = held.where("count >= 3").orderBy(F.desc("count"), "feature").limit(2 * MOST_FEATURES).collect()
        features = [np.uint64(r["feature"] & (2**64 - 1)) for r in rows]
        words = np.array(sorted(h for h, r in zip(features, rows, strict=True) if 2 * r["count"] >= cells[int(h) & ((1 << CELL_BITS) - 1)]), np.uint64)
        if not len(words):
            return flat
        table = sample.mapInArrow(_present(spark.sparkContext.broadcast(words)), "positive boolean, at array<int>").toArrow()  # numbers alone, of the bounded sample
        x: dict[bool, list[list[int]]] = {True: [], False: []}
        for kind, at in zip(table.column("positive").to_pylist(), table.column("at").to_pylist(), strict=True):
            x[kind].append(at)

    def matrix(rows: list[list[int]]) -> np.ndarray:
        m = np.zeros((len(rows), len(words)), np.uint8)
        for i, at in enumerate(sorted(rows)):  # in one order, so that reruns agree
            m[i, at] = 1
        return m

    weights, bias = fit_nnpu(matrix(x[True]), matrix(x[False]), prior)
    return Model(words, weights, bias)


class _Active(dict):
    """The model's features that a word shows, by place; most words show none."""

    def __init__(self, model: Model):
        super().__init__()
        self.place = {int(h): i for i, h in enumerate(model.words)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= WORD_MEMORY:
            self.clear()
        parts = [word] + [word[:k] + b"*" for k in BEGINNINGS if len(word) > k]
        value = self[word] = tuple(self.place[h] for p in parts if (h := xxhash.xxh3_64_intdigest(p)) in self.place)
        return value


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1; higher: likelier toxic), for every row; only ``text`` is read.

    A null text scores as the empty one; very long texts are read whole.  Without
    a model (nothing labelled) every score is 0; equal texts score alike.  A column
    of that name is replaced; other columns and repeated rows stay; an empty table
    gives no rows.
    """
    docs = without(docs, "score")
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    small_batches(docs.sparkSession)
    get = sent(docs.sparkSession, model)

    def run(batches):
        known = get()
        active = _Active(known)
        for batch in batches:
            z = np.array([known.weights[sorted({i for w in words_in(t) for i in active[w]})].sum() for t in column_bytes(batch, "text")]) + known.bias
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"score": pa.array(0.5 * (1 + np.tanh(z / 2)), pa.float64())}
            yield pa.RecordBatch.from_pydict(columns)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(tidy(run), f"{kinds}, score double")
