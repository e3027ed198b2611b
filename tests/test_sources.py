"""File formats, analytics of records, sweeps and streaming."""

import struct

import numpy as np
import pytest

from nearfield.operators.search import exact_knn
from nearfield.plans import experiments as X
from nearfield.plans import theory
from nearfield.plans.grid import Run, run_grid
from nearfield.sources import fvecs, metrics, neighbours_text, prepare, vector_text
from nearfield.streaming.search import stream_knn

KIND = "id long, v array<double>"


def test_canonical_text(spark, tmp_path):
    rows = [(7, [12.5, 1e-05, -3.0]), (9, [0.0, 1.0, 2.0])]
    vector_text.write_vectors(spark.createDataFrame(rows, KIND), f"{tmp_path}/v")
    assert vector_text.read_shape(spark, f"{tmp_path}/v") == (2, 3)
    assert {r["id"]: r["v"] for r in vector_text.read_vectors(spark, f"{tmp_path}/v").collect()} == {0: rows[0][1], 1: rows[1][1]}
    (tmp_path / "own.txt").write_text("2\n2\n5 12.5 1e-05 \n17 -3 4 \n")
    assert {r["id"]: r["v"] for r in vector_text.read_vectors(spark, f"{tmp_path}/own.txt").collect()} == {5: [12.5, 1e-05], 17: [-3.0, 4.0]}


def test_word_vectors_and_hold_out(spark, tmp_path):
    (tmp_path / "g.txt").write_text("".join(f"word{i} {i}.5 -{i} 1e-2\n" for i in range(20)))
    rows = vector_text.read_word_vectors(spark, f"{tmp_path}/g.txt", 12, 3).orderBy("id").collect()
    assert len(rows) == 12 and rows[3]["v"] == [3.5, -3.0, 0.01] and rows[11]["id"] == 11
    data, queries = prepare.prepare(spark, "glove", f"{tmp_path}/d", f"{tmp_path}/q", path=f"{tmp_path}/g.txt", n=12, dim=3, n_queries=4)
    assert (data.count(), queries.count()) == (8, 4)
    assert vector_text.read_shape(spark, f"{tmp_path}/d") == (8, 3)
    with pytest.raises(ValueError):
        prepare.prepare(spark, "csv", "a", "b")


def test_fvecs(spark, tmp_path):
    content = b"".join(struct.pack("<i3f", 3, i, i + 0.5, -i) for i in range(5))
    (tmp_path / "a.fvecs").write_bytes(content)
    assert [r["v"] for r in fvecs.read_fvecs(spark, f"{tmp_path}/a.fvecs").orderBy("id").collect()] == [[i, i + 0.5, -i] for i in range(5)]
    assert fvecs.encode(fvecs.decode(content)) == content
    with pytest.raises(ValueError):
        fvecs.decode(content[:-2])
    (tmp_path / "b.fvecs").write_bytes(content)
    both = fvecs.read_fvecs(spark, f"{tmp_path}/[ab].fvecs").orderBy("id").collect()
    assert [r["id"] for r in both] == list(range(10)) and both[7]["v"] == [2, 2.5, -2]
    (tmp_path / "none.fvecs").write_bytes(b"")
    assert fvecs.read_fvecs(spark, f"{tmp_path}/none.fvecs").count() == 0
    a, _ = prepare.prepare(spark, "sift", f"{tmp_path}/d", f"{tmp_path}/q", data=f"{tmp_path}/a.fvecs", queries=f"{tmp_path}/a.fvecs")
    assert a.count() == 5


def test_truth_files(spark, tmp_path):
    rows = [(0, 1, 5, 0.25), (0, 2, 3, 0.5), (12, 1, 4, 1e-9)]
    found = spark.createDataFrame(rows, "q_id long, rank int, d_id long, dist double")
    neighbours_text.write_neighbours(found, f"{tmp_path}/t")
    assert sorted(map(tuple, neighbours_text.read_neighbours(spark, f"{tmp_path}/t").collect())) == rows
    lines = [r["value"] for r in neighbours_text.formatted(found).orderBy("q", "r").collect()]
    assert lines == ["2", "2", "0:", "5 0.250000", "3 0.500000", "12:", "4 0.000000"]
    assert [r["value"] for r in neighbours_text.ids_only(found).orderBy("q", "r").collect()] == ["2", "2", "5", "3", "4"]
    assert neighbours_text.first_reported(found, 1).count() == 2


def test_distance_list(spark, tmp_path):
    (tmp_path / "d.txt").write_text("Q1:\n0.5\n0.25\nQ2:\n1\n")
    assert sorted(r["dist"] for r in neighbours_text.read_distances(spark, f"{tmp_path}/d.txt").collect()) == [0.25, 0.5, 1.0]
    assert neighbours_text.read_distances(spark, f"{tmp_path}/d.txt", 0.2).count() <= 3
    assert neighbours_text.read_distances(spark, f"{tmp_path}/d.txt", lines=2).count() == 1


def test_metrics_append_and_report(spark, tmp_path):
    records = X.published(spark)
    metrics.append_metrics(records, f"{tmp_path}/m")
    metrics.append_metrics(records.limit(1), f"{tmp_path}/m")
    again = metrics.read_metrics(spark, f"{tmp_path}/m").collect()
    assert len(again) == 19 and [r["recall"] for r in again] == sorted(r["recall"] for r in again)
    series = X.report(records, records, 10_000, 1024)
    assert len(series) == 6 and series["recall_vs_time"].count() == 18 and series["buffer_vs_sort"].count() == 0
    assert X.lsh_series(records, 3, 0, "sketchDim", "recall").count() == 9
    assert [r["sketchDim"] for r in metrics.read_metrics(spark, f"{tmp_path}/m", metrics.BY_SKETCH).collect()][:3] == [32, 32, 32]
    assert X.of_facet(records, k=1024, THREAD_QUEUE_SIZE=64).count() == sum(r["n"] for r in X.facets(records).where("THREAD_QUEUE_SIZE = 64").collect())
    with pytest.raises(ValueError):
        X.report(records, records, 1, 1, ["nope"])


def test_theory(spark):
    assert theory.rho(spark).first()["rho"] == 1.0
    rows = theory.differing_bits(spark, 32, 45.0, 2.0).collect()
    assert sum(r["close"] for r in rows) == pytest.approx(1) and sum(r["far"] for r in rows) == pytest.approx(1)
    assert max(rows, key=lambda r: r["far"])["n"] == 16


def test_grid(spark):
    x = np.random.default_rng(3).standard_normal((120, 8))
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], KIND)
    data, queries = vectors.where("id >= 10"), vectors.where("id < 10")
    out = run_grid(data, queries, [Run(2, 3), Run(3, 3, candidates=200), Run(6, 3, sketch_dim=8, candidates=20), Run(4, 3, sketch_dim=8, candidates=200), Run(2, 3, key_implementation=7, tables=4), Run(5, 3, key_implementation=5, bits=3, tables=6, sketch_dim=2)]).collect()
    assert len(out) == 6 and out[0]["recall"] == out[1]["recall"] == out[3]["recall"] == 1.0
    assert all(0 <= r["recall"] <= 1 for r in out)


def test_stream(spark, tmp_path):
    x = np.random.default_rng(3).standard_normal((40, 6))
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], KIND)
    data, queries = vectors.where("id >= 5"), vectors.where("id < 5")
    queries.repartition(1).write.parquet(f"{tmp_path}/in")
    seen = {}
    run = stream_knn(spark.readStream.schema(KIND).parquet(f"{tmp_path}/in"), data, 3, lambda found, number: seen.update({number: found.collect()}), checkpoint=f"{tmp_path}/cp")
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, (r for rows in seen.values() for r in rows))) == sorted(map(tuple, exact_knn(data, queries, 3).collect()))
