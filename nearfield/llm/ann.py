"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised by codebooks of their own; a cell is a
pair of centroids.  The inverted lists of the cells are filed by their first
centroid: a file holds the lists of one first centroid, or of a few with few
vectors, and a large file is dealt into parts.  For a query, the
pairs are visited by the sum of the two centroid distances, from a heap, until the
visited cells hold the wanted number of vectors.  The query then goes to the files of
these cells alone, where the vectors on their lists are ranked by their exact
distance.

Codebooks grow with the root of the number of vectors and are fitted on a
bounded sample; every vector is indexed.  The number of vectors to visit is
measured: for a bounded sample of queries the true neighbours are found by a
whole scan, and their cells say how far the visit must go.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import scratch, sent, staged, table_batch

#: Most vectors, and most numbers in them, that the codebooks are fitted on, chosen by hash.
SAMPLE, SAMPLE_NUMBERS = 20_000, 5_000_000
#: Least and most centroids of a half; between, half the root of the number of vectors, as a power of two.
CENTROIDS = (4, 256)
#: Queries, chosen by hash, whose true neighbours say how many vectors a visit must reach.
TRIED = 128
#: Least vectors of a file, most of a part of it, and queries of a block; a task ranks a part against a block.
FILE, PART = 4_096, 65_536
QUERY_BLOCK = 4_096
#: Pairs of a file and a query block up to this number are broadcast (16 MB); more are joined by shuffle.
MOST_BROADCAST = 1_000_000


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        for c in range(len(centres)):
            own = x[near == c]
            if len(own):
                centres[c] = own.mean(0)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


@dataclass
class Codebooks:
    first: np.ndarray
    second: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        h = self.first.shape[1]
        return nearest(x[:, :h], self.first) * len(self.second) + nearest(x[:, h:], self.second)

    def visit(self, q: np.ndarray, counts: np.ndarray):
        """(cell, vectors in the cells so far) by summed distance, from a heap (multi-sequence)."""
        h = self.first.shape[1]
        d1, d2 = ((self.first - q[:h]) ** 2).sum(1), ((self.second - q[h:]) ** 2).sum(1)
        o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        s1, s2 = d1[o1].tolist(), d2[o2].tolist()
        heap, seen, got = [(s1[0] + s2[0], 0, 0)], {(0, 0)}, 0
        while heap:
            _, i, j = heapq.heappop(heap)
            cell = int(o1[i]) * len(o2) + int(o2[j])
            got += int(counts[cell])
            yield cell, got
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < len(s1) and b < len(s2) and (a, b) not in seen:
                    seen.add((a, b))
                    heapq.heappush(heap, (s1[a] + s2[b], a, b))

    def visited(self, q: np.ndarray, counts: np.ndarray, wanted: int) -> np.ndarray:
        """Cells until they hold ``wanted`` vectors."""
        out = []
        for cell, got in self.visit(q, counts):
            out.append(cell)
            if got >= wanted:
                break
        return np.array(out, np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """(id, v) of the rows of ``vectors(vec_id, embedding)`` that take part, with 64-bit components.

    Without null id, null or empty vectors, zero vectors and ones with a null or
    non-finite component; of several lengths the most frequent, then the longest, takes part.
    """
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where("vec_id is not null and embedding is not null").where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("id"), v.alias("v"))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (lengths["n"] if lengths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    values = np.asarray(column.flatten(), np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _by_hash(rows: DataFrame, seed: int, wanted: int, total: int) -> DataFrame:
    cut = int((min(1.0, wanted / max(1, total)) - 0.5) * 2.0**64)
    return rows.where(F.xxhash64("id", F.lit(seed)) <= F.lit(max(-(2**63), min(2**63 - 1, cut))))


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _best(ids: np.ndarray, x: np.ndarray, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k nearest rows of ``x`` to ``q``, without its own id."""
    keep = ids != own
    ids, x = ids[keep], x[keep]
    d = np.sqrt(((x - q) ** 2).sum(1))
    if len(d) > k:
        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        ids, d = ids[near], d[near]
    at = np.lexsort((ids, d))[:k]
    return ids[at], d[at]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def exact_neighbours(rows: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of a bounded number of queries, by a scan of all ``rows(id, v)``."""
    held = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        for b in batches:
            ids, x = np.asarray(b.column(0), np.int64), _matrix(b.column(1))
            for own, q in held.value:
                near, d = _best(ids, x, own, q, k)
                yield table_batch(FOUND, query_id=[own] * len(near), vec_id=near, score=d)

    return _ranked(rows.select("id", "v").mapInArrow(run, "query_id long, vec_id long, score double"), k)


@dataclass
class Index:
    """What every task of a search knows; the inverted lists are a table."""

    books: Codebooks
    counts: np.ndarray  # vectors by cell
    wanted: int  # vectors that a visit reaches
    total: int

    @property
    def share(self) -> float:
        """The share of all vectors in the cells that a query visits, at most one cell more."""
        return min(1.0, self.wanted / max(1, self.total))


def fitted(rows: DataFrame, asked: DataFrame, k: int, recall: float) -> Index | None:
    """Codebooks, cell counts and the reach of a visit, for ``rows(id, v)`` and queries of the same form."""
    spark = rows.sparkSession
    total = rows.count()
    if not total:
        return None
    width = rows.select(F.size("v")).first()[0]
    fit_on = max(1024, min(SAMPLE, SAMPLE_NUMBERS // width))
    table = _by_hash(rows, 31, fit_on, total).select("v").toArrow()
    if not table.num_rows:
        table = rows.select("v").limit(1000).toArrow()
    sample = _matrix(table.column(0).combine_chunks())
    sample = sample[np.lexsort(sample.T[::-1])]  # in one order, so that reruns agree
    centroids = min(CENTROIDS[1], max(CENTROIDS[0], 1 << round(np.log2(max(1.0, total**0.5 / 2)))))
    half = width // 2
    books = Codebooks(kmeans(sample[:, :half], centroids) if half else np.zeros((1, 0)), kmeans(sample[:, half:], centroids))
    size = len(books.first) * len(books.second)
    get = sent(spark, books)

    def count(batches):
        found, known = np.zeros(size, np.int64), get()
        for b in batches:
            if b.num_rows:
                found += np.bincount(known.cells(_matrix(b.column(0))), minlength=size)
        used = np.flatnonzero(found)
        yield table_batch(pa.schema([("cell", pa.int64()), ("n", pa.int64())]), cell=used, n=found[used])

    counts = np.zeros(size, np.int64)
    for r in rows.select("v").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"]] = r["n"]

    tried = _by_hash(asked, 37, TRIED, asked.count()).orderBy(F.xxhash64("id", F.lit(37)), "id").limit(2 * TRIED).collect()
    tried = tried or asked.limit(TRIED).collect()
    queries = [(r["id"], np.array(r["v"])) for r in tried]
    true = exact_neighbours(rows, queries, k).join(rows, F.col("vec_id") == F.col("id")).select("query_id", "vec_id", "score", "v") if queries else None
    reach = []
    vectors = {q: v for q, v in queries}
    near: dict[int, list[np.ndarray]] = {}
    for r in true.collect() if queries else ():
        v = np.array(r["v"])
        if np.sqrt(((v - vectors[r["query_id"]]) ** 2).sum()) <= r["score"] * (1 + 1e-9):
            near.setdefault(r["query_id"], []).append(v)
    for q, found in near.items():
        left = list(books.cells(np.array(found)))
        for cell, got in books.visit(vectors[q], counts):
            reach += [got] * left.count(cell)
            left = [c for c in left if c != cell]
            if not left:
                break
    wanted = int(np.ceil(np.quantile(reach, recall))) if reach else total
    return Index(books, counts, max(wanted, k + 1), total)


def search(vectors: DataFrame, is_query: str, k: int = 10, recall: float = 0.95) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, ties to the smaller vec_id.

    is_query: SQL condition on ``id``.  Candidates are all other ids.  score: the
    Euclidean distance in double precision.  recall: of the true neighbours of the
    tried queries, the share that a visit must reach.  Of rows with equal vec_id the
    query is the one with the least vector; as candidates all count.  A query
    whose cells hold no other vector finds fewer.  See ``usable`` for the rows that
    take no part; without any there are no rows.  Extra columns are ignored.
    """
    spark = vectors.sparkSession
    with scratch(spark):
        rows = usable(vectors)
        asked = staged(rows.where(is_query).groupBy("id").agg(F.min("v").alias("v")))
        index = fitted(rows, asked, k, recall)
        if index is None:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        return staged(_searched(rows, asked, index, k), stays=True)


def _searched(rows: DataFrame, asked: DataFrame, index: Index, k: int) -> DataFrame:
    spark = rows.sparkSession
    get = sent(spark, index)
    second = len(index.books.second)
    by_first = index.counts.reshape(-1, second).sum(1)
    file_of, held = np.zeros(len(by_first), np.int64), 0
    for i in range(1, len(by_first)):
        held += by_first[i - 1]
        file_of[i] = file_of[i - 1] + (held >= FILE)
        held *= held < FILE
    opens = np.searchsorted(file_of, np.arange(file_of[-1] + 1)) * second  # the first cell of each file
    widths = np.diff(np.append(opens, len(index.counts)))
    parts = np.maximum(1, -(-np.bincount(file_of, weights=by_first).astype(np.int64) // PART))

    # Queries of near cells share a block, since they visit the same lists; a crowded cell has several blocks.
    asked_cells = np.zeros(len(index.counts), np.int64)

    def own_cell(batches):
        schema = pa.schema([("cell", pa.int64())])
        for b in batches:
            if b.num_rows:
                yield table_batch(schema, cell=get().books.cells(_matrix(b.column(0))))

    for r in asked.select("v").mapInArrow(own_cell, "cell long").groupBy("cell").count().collect():
        asked_cells[r["cell"]] = r["count"]
    before = np.cumsum(asked_cells) - asked_cells
    first_block, many = before // QUERY_BLOCK, np.maximum(1, -(-asked_cells // QUERY_BLOCK))
    planned = pa.schema([("file", pa.int32()), ("part", pa.int32()), ("block", pa.int32()), ("id", pa.int64()), ("v", pa.list_(pa.float64())), ("cells", pa.binary())])
    blocks = spark.sparkContext.broadcast((first_block, many, parts, file_of, opens, widths))

    def plan(batches):
        """A row for each part of each file that a query visits, with a bit for each of its cells there."""
        known, (first, several, dealt, where, begin, wide) = get(), blocks.value
        for b in batches:
            out = {f.name: [] for f in planned}
            x = _matrix(b.column(1))
            homes = known.books.cells(x) if len(x) else ()
            for own, q, home in zip(b.column(0).to_pylist(), x, homes, strict=True):
                cells = known.books.visited(q, known.counts, known.wanted)
                block = int(first[home] + own % several[home])
                files = where[cells // second]
                for at in np.unique(files):
                    marks = np.zeros(wide[at], bool)
                    marks[cells[files == at] - begin[at]] = True
                    bits = np.packbits(marks).tobytes()
                    for part in range(dealt[at]):
                        for name, value in zip(out, (int(at), part, block, own, q, bits), strict=True):
                            out[name].append(value)
            yield table_batch(planned, **out)

    # A visit takes some ten milliseconds, so few queries make a task.
    tasks = int(min(4096, asked_cells.sum() // 32 + 1))
    going = staged(asked.select("id", "v").repartition(tasks).mapInArrow(plan, "file int, part int, block int, id long, v array<double>, cells binary"))
    filed_schema = pa.schema([("file", pa.int32()), ("part", pa.int32()), ("cell", pa.int32()), ("vec", pa.int64()), ("x", pa.list_(pa.float64()))])

    def file(batches):
        known, (_, _, dealt, where, begin, _) = get(), blocks.value
        for b in batches:
            if b.num_rows:
                ids = np.asarray(b.column(0), np.int64)
                cells = known.books.cells(_matrix(b.column(1)))
                at = where[cells // second]
                part = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % dealt[at]
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array((cells - begin[at]).astype(np.int32)), b.column(0), b.column(1).cast(pa.list_(pa.float64()))], schema=filed_schema)

    filed = rows.select("id", "v").mapInArrow(file, "file int, part int, cell int, vec long, x array<double>")
    wanted = staged(going.select("file", "block").distinct())
    filed = filed.join(F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted, "file")

    def rank(_, queries: pa.Table, entries: pa.Table) -> pa.Table:
        out = ([], [], [])
        if queries.num_rows and entries.num_rows:
            inside = np.asarray(entries.column("cell"), np.int64)
            order = np.argsort(inside, kind="stable")  # the lists, one after the other
            inside, ids, x = inside[order], np.asarray(entries.column("vec"), np.int64)[order], _matrix(entries.column("x").combine_chunks())[order]
            cells, starts = np.unique(inside, return_index=True)
            ends = np.append(starts[1:], len(inside))
            for own, q, bits in zip(queries.column("id").to_pylist(), _matrix(queries.column("v").combine_chunks()), queries.column("cells").to_pylist(), strict=True):
                own_lists = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))[cells])
                if not len(own_lists):
                    continue
                at = np.concatenate([np.arange(starts[c], ends[c]) for c in own_lists])
                near, d = _best(ids[at], x[at], own, q, k)
                out[0].extend([own] * len(near))
                out[1].extend(near)
                out[2].extend(d)
        return pa.table({f.name: pa.array(v, f.type) for f, v in zip(FOUND, out, strict=True)})

    keys = ("file", "part", "block")
    found = going.groupBy(*keys).cogroup(filed.groupBy(*keys)).applyInArrow(rank, "query_id long, vec_id long, score double")
    return _ranked(found, k)
