"""Neighbours in a grid of blocks, and the vector index: recall, the exact way, adding, replacing, deleting, compaction."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptloom.operators import memory, neighbours, vector_index
from promptloom.operators.vector_index import VectorIndex


def frame(spark, x, name="id", first=0):
    return spark.createDataFrame([(i + first, [float(c) for c in v]) for i, v in enumerate(x)], f"{name} long, vector array<double>")


def units(rng, n, dim=16, centres=None, spread=0.3):
    x = rng.normal(size=(n, dim)) if centres is None else centres[rng.integers(len(centres), size=n)] + spread * rng.normal(size=(n, dim))
    return vector_index.unit(x)


def exact(q, x, k):
    s = q @ x.T
    return {(i, j) for i in range(len(q)) for j in sorted(range(len(x)), key=lambda j: (-round(s[i, j], 12), j))[:k]}


def test_grid_bounds_rows_per_task(spark, monkeypatch):
    """No cell holds much more than a block of queries, nor sees much more than PASSING blocks of entries, and every pair meets once."""
    monkeypatch.setattr(neighbours, "PASSING", 3)
    rng = np.random.default_rng(1)
    q, x = frame(spark, units(rng, 900), "query_id"), frame(spark, units(rng, 1500))
    cells = neighbours.cells(q, x, 100).groupBy("eb", "qb", "side").count()
    assert cells.where("side = 0").agg(F.max("count")).first()[0] <= 200
    assert cells.where("side = 1").agg(F.max("count")).first()[0] <= 450
    assert cells.select("eb", "qb").distinct().count() == 9 * 5
    met = cells.groupBy("eb", "qb").agg(F.expr("sum(if(side = 0, count, 0)) * sum(if(side = 1, count, 0))").alias("pairs"))
    assert met.agg(F.sum("pairs")).first()[0] == 900 * 1500


@pytest.mark.parametrize("block", [40, 4096])
def test_nearest_of_two_large_sides(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "PASSING", 3)
    monkeypatch.setattr(neighbours, "STEP", 30)
    rng = np.random.default_rng(2)
    x, q = units(rng, 300, 8), units(rng, 170, 8)
    x[17] = x[5]
    got = neighbours.nearest(frame(spark, q, "query_id"), frame(spark, x), 4, block).collect()
    assert {(r["query_id"], r["id"]) for r in got} == exact(q, x, 4) and len(got) == 170 * 4


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    x = units(rng, 3000, centres=centres)
    made = VectorIndex.build(spark, str(tmp_path_factory.mktemp("index") / "i"), frame(spark, x))
    return made, x, units(rng, 200, centres=centres)


def test_index_recall(spark, index):
    made, x, q = index
    assert made.model.probes < len(made.model.centroids) / 2  # clustered: few lists do
    asked = frame(spark, q, "query_id")
    got = {(r["query_id"], r["id"]) for r in made.search(asked).collect()}
    assert len(got & exact(q, x, 5)) / (5 * len(q)) >= 0.9
    assert made.recall(asked).agg(F.avg("recall")).first()[0] >= 0.9
    assert {(r["query_id"], r["id"]) for r in made.exact(asked).collect()} == exact(q, x, 5)
    every = made.search(asked, probes=10_000, again=3000)
    assert {(r["query_id"], r["id"]) for r in every.collect()} == exact(q, x, 5)


def test_index_of_vectors_without_clusters(spark, tmp_path):
    """Random vectors: the index measures that it has to probe most lists, and keeps its recall."""
    rng = np.random.default_rng(4)
    x, q = units(rng, 1500, 32), units(rng, 150, 32)
    made = VectorIndex.build(spark, str(tmp_path / "i"), frame(spark, x))
    assert made.recall(frame(spark, q, "query_id")).agg(F.avg("recall")).first()[0] >= 0.9


def test_index_reads_only_probed_lists(spark, index):
    made, x, q = index
    plan = made.search(frame(spark, q[:1], "query_id"))._jdf.queryExecution().executedPlan().toString()
    assert any(" IN (" in f and "list#" in f for f in re.findall(r"PartitionFilters: \[(.*)", plan))
    assert "ReadSchema: struct<id:bigint,code:binary>" in plan  # vectors are read for the second look only


def test_index_adds_replaces_and_deletes(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    x = units(rng, 300, 8)
    path = str(tmp_path / "i")
    made = VectorIndex.build(spark, path, frame(spark, x[:200]))
    with pytest.raises(FileExistsError):
        VectorIndex.build(spark, path, frame(spark, x[:10]))
    made.add(frame(spark, x[200:], first=200), writer="w", batch=0)
    made.add(frame(spark, x[200:], first=200), writer="w", batch=0)
    again = x.copy()
    again[10:20] = units(rng, 10, 8)
    made.add(frame(spark, again[10:20], first=10))
    made.delete(spark.createDataFrame([(3,), (999,)], "id long"))
    left = [i for i in range(300) if i != 3]
    q = again[[3, 12, 250]]

    def check(index):
        assert index.rows().count() == 299
        got = [(r["query_id"], r["id"]) for r in index.exact(frame(spark, q, "query_id"), 3).collect()]
        assert set(got) == {(i, left[j]) for i, j in exact(q, again[left], 3)}
        near = index.search(frame(spark, q, "query_id"), 3, probes=10_000, again=300).collect()
        assert {(r["query_id"], r["id"]) for r in near} == set(got)

    check(made)
    check(VectorIndex(spark, path))  # opened again
    made.compact()
    assert len(made.log.last()["parts"]) == 1
    check(made)
    made.add(frame(spark, x[3:4], first=3))
    assert made.rows().count() == 300


def test_index_in_blocks(spark, index, monkeypatch):
    """Many blocks of queries and of entries: the same candidates."""
    made, x, q = index
    asked = frame(spark, q, "query_id")
    want = {(r["query_id"], r["id"]) for r in made.search(asked).collect()}
    monkeypatch.setattr(neighbours, "BLOCK", 30)
    monkeypatch.setattr(vector_index, "ENTRIES", 700)
    assert len(want - {(r["query_id"], r["id"]) for r in made.search(asked).collect()}) <= len(want) / 100


def test_index_edges(spark, tmp_path):
    odd = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, None), (None, [1.0, 0.0]), (4, [2.0]), (5, [1.0, 1.0])], "id long, vector array<double>")
    made = VectorIndex.build(spark, str(tmp_path / "i"), odd)
    assert made.rows().count() == 4
    q = spark.createDataFrame([(7, [3.0, 3.0]), (8, None), (9, [0.0, 0.0])], "query_id long, vector array<double>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in made.search(q, 2, probes=99).collect()}
    assert got[7, 1] == 2 and got[7, 2] == 5 and (8, 1) not in got
    empty = VectorIndex.build(spark, str(tmp_path / "e"), odd.limit(0))
    assert empty.search(q).count() == 0 and empty.exact(q).count() == 0


def test_indexed_memory(spark, tmp_path):
    """The memory with an index behind it: the same recall as the table, similarities within 0 and 1, every id once."""
    text = "seq long, id string, text string, composite double, accepted boolean, decision string, n_findings int, token_reduction double"
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(i, f"h{i}", f"{words[i % 8]} {words[i // 8 % 8]} report {i % 3}", 0.5, True, "allow", 0, 0.0) for i in range(60)]
    table, known = memory.TableBackend(spark, str(tmp_path / "t")), memory.IndexedBackend(spark, str(tmp_path / "i"))
    for part in (rows[:40], rows[30:]):
        writes = memory.entries(spark.createDataFrame(part, text))
        table.upsert(writes)
        known.upsert(writes)
    assert known.size() == 60
    asked = spark.createDataFrame([(1, "alpha beta report 1"), (2, "zzz")], "prompt_id long, text string").select("prompt_id", memory.hash_embed("text").alias("vector"))
    key = lambda df: sorted((r["prompt_id"], r["rank"], round(max(0.0, r["similarity"]), 6)) for r in df.collect())
    assert key(known.query(asked, 3)) == key(table.query(asked, 3))
    assert all(0 <= r["similarity"] <= 1 for r in known.query(asked, 3).collect())
    known.clear()
    assert known.size() == 0 and known.query(asked, 3).count() == 0


@pytest.mark.parametrize("large", [1.0, 1e20])
def test_best_of_blocks(large):
    """What single precision leaves out counts for nothing: copies, near copies, numbers beyond it, any order of ids, some of the queries."""
    rng = np.random.default_rng(6)
    x = units(rng, 1500, 8)
    x[300:700] = x[5] + 1e-9 * rng.integers(3, size=(400, 1)) * x[6]
    q = np.concatenate([x[:40], x[300:310]]) * large
    top, rows = neighbours.Top(q, 4), np.arange(0, 50, 2)
    ids = rng.permutation(1500)
    for at in range(0, 1500, 700):
        top.take(ids[at : at + 700], x[ids[at : at + 700]], rows)
    score, found = top.settled()
    assert (score[1::2] == -np.inf).all()
    got = {(i, j) for i in rows.tolist() for j in found[i].tolist()}
    s = np.einsum("ij,kj->ik", q, x)
    assert got == {(i, j) for i in rows.tolist() for j in sorted(range(1500), key=lambda j: (-round(s[i, j], 12), j))[:4]} or large > 1 and np.allclose(score[rows], -np.sort(-s[rows], axis=1)[:, :4], rtol=1e-12)


def test_vectors_as_bytes():
    import pyarrow as pa

    for kind, size in ((pa.float32(), np.float32), (pa.float64(), np.float64)):
        column = pa.array([[1.5, 2.5], [], [3.5], [float("nan"), 1.0]], pa.list_(kind))
        for at in range(4):
            assert np.array_equal(neighbours.unpacked(neighbours.packed(column).slice(at), size)[:, :2], neighbours.vectors(column)[at:])


def test_batch_that_is_there_is_not_written(spark, tmp_path):
    x = units(np.random.default_rng(7), 60, 8)
    made = VectorIndex.build(spark, str(tmp_path / "i"), frame(spark, x[:40]))
    made.add(frame(spark, x[40:], first=40), "w", 0)
    parts = made.log.files.names("data")
    made.add(frame(spark, x[40:], first=40), "w", 0)
    assert len(made.log.files.names("data")) == len(parts) and made.rows().count() == 60
