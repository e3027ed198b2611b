"""Operators of the vector engine on rows at the edges, and their properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import distances as D
from nearfield.functions.families import CrossPolytope, JL, MinHash, OneBitMinHash, SimHash, next_power_of_two, with_hash
from nearfield.operators import evaluate as E
from nearfield.operators import preprocess as P
from nearfield.operators import search as S
from nearfield.operators.split import dense_ids, hold_out
from nearfield.operators.topk import nearest

KIND = "id long, v array<double>"


def frame(spark, rows):
    return spark.createDataFrame(rows, KIND)


def random_vectors(spark, n, dim=12, seed=1, first=0):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return frame(spark, [(first + i, r.tolist()) for i, r in enumerate(x)]), x


def listed(found):
    return [tuple(r) for r in found.orderBy("q_id", "rank").collect()]


def test_ties_zero_and_opposite_vectors(spark):
    data = frame(spark, [(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (4, [-1.0, 0.0])])
    queries = frame(spark, [(0, [1.0, 0.0]), (9, [0.0, 0.0])])
    for find in (S.exact_knn, S.exact_knn_columns):
        assert listed(find(data, queries, 5)) == [(0, 1, 1, 0.0), (0, 2, 3, 0.0), (0, 3, 4, 2.0)]
    assert listed(S.exact_knn(data, queries, 1, "angular"))[0][3] == 0.0
    assert listed(S.exact_knn(data, queries, 2, 3))[:2] == [(0, 1, 3, 0.0), (0, 2, 1, 1.0)]


@pytest.mark.parametrize("metric", ["cosine", "neg_cosine", "angular", "euclidean", "gen_jaccard"])
def test_kernels_equal_columns(spark, metric):
    data, _ = random_vectors(spark, 60)
    queries, _ = random_vectors(spark, 7, seed=2, first=1000)
    a, b = listed(S.exact_knn(data, queries, 9, metric)), listed(S.exact_knn_columns(data, queries, 9, metric))
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert np.allclose([x[3] for x in a], [x[3] for x in b])


def test_several_query_blocks(spark, monkeypatch):
    from nearfield.operators import topk

    data, _ = random_vectors(spark, 40)
    queries, _ = random_vectors(spark, 11, seed=3, first=100)
    want = listed(nearest(data, queries, 4, "cosine"))
    monkeypatch.setattr(topk, "BLOCK_NUMBERS", 24)
    monkeypatch.setattr(topk, "HELD", 50)
    assert listed(nearest(data, queries, 4, "cosine")) == want


def test_errors(spark):
    data, _ = random_vectors(spark, 4)
    with pytest.raises(ValueError):
        D.distance("nope", F.col("v"), F.col("v"))
    with pytest.raises(ValueError):
        nearest(data, data, 1, "nope")
    with pytest.raises(ValueError):
        S.LshIndex(JL(12, 2))
    with pytest.raises(ValueError):
        S.sketch_candidates(data, data, CrossPolytope(12, 2), 3)
    with pytest.raises(Exception, match="components"):
        nearest(data, frame(spark, [(1, [1.0, 2.0])]), 1, "cosine").collect()


def test_sketch_distances_by_code(spark):
    t = spark.createDataFrame([([0b1011, 0], [0b0001, 1], [1.0, 2.0], [0.0, 4.0])], "a array<long>, b array<long>, x array<double>, y array<double>")
    a, b = F.col("a"), F.col("b")
    got = t.select(D.sketch_distance(3, a, b), D.sketch_distance(4, a, b), D.sketch_distance(5, a, b), D.sketch_distance(6, F.col("x"), F.col("y"))).first()
    assert tuple(got) == (3.0, 1.0, 3 / 64, 5.0)
    with pytest.raises(ValueError):
        D.sketch_distance(2, a, b)


def test_empty_sides(spark):
    data, _ = random_vectors(spark, 4)
    empty = frame(spark, [])
    assert listed(S.exact_knn(data, empty, 3)) == []
    assert listed(S.exact_knn(empty, data, 3)) == []
    assert S.LshIndex(SimHash(12, 2, 4)).build(empty).query(empty, data, 3).collect() == []


def test_recall_grows_with_candidates_and_tables(spark):
    data, _ = random_vectors(spark, 300)
    queries, _ = random_vectors(spark, 20, seed=5, first=1000)
    truth = S.exact_knn(data, queries, 5).cache()
    family = SimHash(12, 2)
    values = [E.recall(truth, S.sketch_knn(data, queries, family, 5, c), 5).first()["recall"] for c in (5, 40, 300)]
    assert values == sorted(values) and values[-1] == 1.0
    index = S.LshIndex(SimHash(12, 6, 3)).build(data)
    few, more = (set(map(tuple, index.candidates(queries, t).collect())) for t in (2, 6))
    assert few <= more
    assert E.recall(truth, truth, 5).first()["recall"] == 1.0
    found = S.sketch_knn(data, queries, family, 5, 40)
    assert E.distance_ratio(truth, found, 5).first()["ratio"] >= 1.0
    assert E.evaluate(truth, found, 5).columns == ["recall", "ratio"]


def test_saved_index(spark, tmp_path):
    data, _ = random_vectors(spark, 50)
    index = S.LshIndex(SimHash(12, 3, 4)).build(data)
    index.save(f"{tmp_path}/index")
    again = S.LshIndex(index.family).load(spark, f"{tmp_path}/index")
    assert listed(again.query(data, data, 3)) == listed(index.query(data, data, 3))


def test_simhash_bits_follow_the_angle(spark):
    rng = np.random.default_rng(0)
    a = rng.standard_normal(20)
    b = a + 0.7 * rng.standard_normal(20)
    angle = math.acos(a @ b / np.linalg.norm(a) / np.linalg.norm(b))
    words = SimHash(20, 400)(np.stack([a, b]))
    differing = np.bitwise_count(words[0] ^ words[1]).sum() / (400 * 32)
    assert differing == pytest.approx(angle / math.pi, abs=0.02)


def test_minhash_matches_follow_jaccard():
    rng = np.random.default_rng(0)
    a, b = rng.random(20), rng.random(20)
    jaccard = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    values = MinHash([1] * 20, 4000)(np.stack([a, b]))
    assert (values[0] == values[1]).mean() == pytest.approx(jaccard, abs=0.04)
    words = OneBitMinHash([1] * 20, 125)(np.stack([a, b]))
    assert np.bitwise_count(words[0] ^ words[1]).sum() / 4000 == pytest.approx((1 - jaccard) / 2, abs=0.05)
    assert (MinHash([1] * 20, 5)(np.zeros((1, 20)) - 1) == 256).all()


def test_cross_polytope_is_a_rotation():
    f = CrossPolytope(10, 3)
    m = f.matrices
    assert m.shape == (3, 16, 10) and next_power_of_two(10) == 16
    assert np.allclose(m[0].T @ m[0], np.eye(10) * 16**3)
    x = np.random.default_rng(1).standard_normal((5, 10))
    keys, opposite = f(x), f(-x)
    assert ((keys - opposite) % 16 == 0).all() and (keys != opposite).all()


def test_preparation(spark):
    data, queries = frame(spark, [(1, [0.5, -1.2]), (2, [3.0, 4.0])]), frame(spark, [(3, [-0.1, 0.0])])
    assert [r["m"] for r in P.dim_mins(data, queries).orderBy("pos").collect()] == [-1, -2]
    moved, _ = P.non_negative(data, queries)
    assert [r["v"] for r in moved.orderBy("id").collect()] == [[1.5, 0.8], [4.0, 6.0]]
    a, b, bounds = P.minhash_ready(data, queries)
    assert bounds == [1, 1]
    assert [r["first_slot"] for r in P.index_map(P.dim_bounds(a, b)).orderBy("pos").collect()] == [0, 1]
    assert P.unit_vectors(frame(spark, [(1, [0.0, 0.0]), (2, [3.0, 4.0])])).collect()[0]["v"] == [0.6, 0.8]


def test_hold_out(spark):
    vectors, _ = random_vectors(spark, 30, first=100)
    data, queries = hold_out(vectors, 7)
    assert sorted(r["id"] for r in data.collect()) == list(range(23)) and sorted(r["id"] for r in queries.collect()) == list(range(7))
    assert {tuple(r["v"]) for r in data.union(queries).collect()} == {tuple(r["v"]) for r in vectors.collect()}
    assert [r["id"] for r in dense_ids(frame(spark, [(1 << 20, [1.0]), (5, [2.0]), (70_000, [3.0])])).orderBy("v").collect()] == [2, 0, 1]


def test_histograms(spark):
    d = spark.createDataFrame([(x / 10,) for x in range(11)], "dist double")
    assert {r["bin"]: r["n"] for r in E.distance_histogram(d, 5).collect()} == {1: 2, 2: 2, 3: 2, 4: 2, 5: 3}
    h = spark.createDataFrame([([1, 2],), ([1, 3],)], "sketch array<long>")
    assert {r["value"]: r["n"] for r in E.hash_histogram(h).collect()} == {1: 2, 2: 1, 3: 1}
    assert {r["full_key"] for r in E.key_histogram(h).collect()} == {"0000000100000010", "0000000100000011"}


def test_sketches_do_not_depend_on_partitions(spark):
    vectors, _ = random_vectors(spark, 40)
    family = SimHash(12, 3)
    a = {r["id"]: r["s"] for r in with_hash(vectors, family, "s").collect()}
    b = {r["id"]: r["s"] for r in with_hash(vectors.repartition(7), family, "s").collect()}
    assert a == b


def test_keys_grow_with_the_data():
    from nearfield.functions.families import CrossPolytope, SimHash
    from nearfield.operators.search import BUCKET_ROWS, LshIndex, key_bits

    assert [key_bits(n) for n in (0, 100, 4096, 4097, 1 << 20, 1 << 60)] == [4, 4, 4, 5, 12, 31]
    assert all((1 << key_bits(n)) * BUCKET_ROWS >= n for n in (5_000, 10**6, 10**9))
    assert LshIndex(SimHash(8, groups=2, bits=4)).sized(1 << 20).family.bits == 12
    assert LshIndex(CrossPolytope(8, groups=2)).sized(1 << 20).family.groups == 2
