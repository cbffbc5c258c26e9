import numpy as np
from pyspark.sql import functions as F

from stratalane.llm import ann
from stratalane.session import load


def brute(rows, asked, top=20):
    """rows: {vec_id: vector}."""
    ids = np.array(sorted(rows))
    body = np.array([rows[i] for i in ids], dtype=np.float64)
    out = {}
    for q in asked:
        score = (body * np.array(rows[q], dtype=np.float64)).sum(axis=1)
        order = np.lexsort((ids, -score))
        out[q] = [(int(ids[i]), float(score[i])) for i in order if ids[i] != q][:top]
    return out


def got(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_scores(spark):
    table = load(spark, "/root/testdata/sf0.1", "embeddings")
    rows = {r.vec_id: r.embedding for r in table.collect()}
    found = got(ann.nearest(table, F.col("vec_id") % 20 == 0))
    want = brute(rows, [i for i in rows if i % 20 == 0])
    assert set(found) == set(want)
    hits = 0
    for q, near in found.items():
        assert len(near) == 20 and near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - np.dot(np.array(rows[q], dtype=float), np.array(rows[v], dtype=float))) < 1e-9 for v, s in near)
        hits += len({v for v, _ in near} & {v for v, _ in want[q]})
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_copies_ties_and_what_takes_no_part(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(50)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(60, 160)]  # one vector that most rows share
    rows += [rows[0], (200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan"), 0.0, 0.0, 0.0]), (204, [float("inf"), 0.0, 0.0, 0.0]), (220, [1.0]), (None, [1.0] * 4)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, leaf string")
    found = got(ann.nearest(table, F.col("vec_id") % 20 == 0))
    real = {i: np.array(v, dtype=np.float32) for i, v in rows if i is not None and i < 200}
    want = brute(real, [i for i in real if i % 20 == 0])
    assert {q: [v for v, _ in near] for q, near in found.items()} == {q: [v for v, _ in near] for q, near in want.items()}


def test_few_rows_and_none(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert got(ann.nearest(table, F.col("vec_id") % 20 == 0)) == {0: [(2, 2.0), (1, 0.5)]}
    assert ann.nearest(table.where("vec_id > 5"), F.col("vec_id") % 20 == 0).collect() == []
    assert ann.nearest(table.where("vec_id = 0"), F.col("vec_id") % 20 == 0).collect() == []


def test_doubles_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(80)] + [(100 + i, [float(x) for x in rng.normal(size=3)]) for i in range(41)]
    rows += [(7, [5.0] * 6), (7, [-5.0] * 6), (40, [3.0, 2.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = got(ann.nearest(table, F.col("vec_id") % 20 == 0, recall=1.0))
    for q, near in found.items():
        asks = min(v for i, v in rows if i == q)
        best = {}
        for i, v in rows:
            if i != q and len(v) == len(asks):
                best[i] = max(best.get(i, -np.inf), float((np.array(v) * np.array(asks)).sum()))
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:20]
        assert [v for v, _ in near] == [v for v, _ in want] and np.allclose([s for _, s in near], [s for _, s in want])
    assert set(found) == {0, 20, 40, 60, 100, 120, 140}


def test_small_leaves_still_give_whole_answers(spark):
    """Tight clusters, one of them tiny: its query has to look beyond its own leaf."""
    rng = np.random.default_rng(6)
    rows = [(i + 1, [float(x) for x in np.eye(8)[i % 7] * 10 + rng.normal(size=8) / 100]) for i in range(1400)] + [(2000, [float(x) for x in np.eye(8)[7] * 10])]
    found = got(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0))
    assert all(len(near) == 20 for near in found.values()) and 2000 in found
