import zlib

import numpy as np
import pyarrow as pa

from wavelake.llm.boosting import FEATURES, fit, keep_good, op8_boosting, statistics, train

from .conftest import SF


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op8_boosting(spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95


def test_same_rows_give_the_same_model(spark):
    one, two = (op8_boosting(spark, SF).orderBy("doc_id").collect() for _ in range(2))
    assert one == two


def test_trees_against_plain_traversal():
    random = np.random.default_rng(0)
    x = random.normal(size=(600, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit(x, y)
    assert np.mean((model.scores(x) > 0.5) == y) > 0.97
    for row, score in zip(x[:40], model.scores(x[:40]), strict=True):
        total = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            total += leaf[at - len(f)]
        assert abs(1 / (1 + np.exp(-total)) - score) < 1e-9


def test_statistics_do_not_depend_on_neighbours(documents):
    texts = ["", None, "a", *(t for _, t, _ in documents[:30])]
    whole = statistics(pa.array(texts))
    assert whole.shape == (33, len(FEATURES)) and np.isfinite(whole).all()
    assert all(np.array_equal(statistics(pa.array([t], pa.string()))[0], row) for t, row in zip(texts, whole, strict=True))


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(7, 0, None), (10, 1, 1), (11, 1, 0), (None, 1, 0), (9, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    model = train(odd, labels)
    assert len(model.scores(statistics(pa.array(["", "x"])))) == 2
    kept = keep_good(odd, labels)
    assert kept.columns == odd.columns and keep_good(odd.limit(0), labels).count() == 0
    assert keep_good(odd, labels.limit(0)).count() == 9
