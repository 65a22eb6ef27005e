from __future__ import annotations

import zlib

import duckdb
import numpy as np

from tests.llm.helpers import empty, odd_rows
from tidemark.llm import quality
from tidemark.llm.queries import op8

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    label = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    rows = op8(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in label]
    good = [r["score"] for r in held if label[r["doc_id"]] == 1]
    bad = [r["score"] for r in held if label[r["doc_id"]] == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.93
    assert np.mean([r["predicted"] == label[r["doc_id"]] for r in held]) > 0.93
    assert np.mean([g >= 0.7 for g in good]) > 0.97
    assert sorted(rows) == sorted(op8(spark, SF).collect())


def test_labels_outside_the_training_rows_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = labels.where(quality.remainder(labels["doc_id"]) != 2)
    a, b = quality.fit(docs, labels), quality.fit(docs, kept)
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.network.weights[0], b.network.weights[0])


def test_word_vectors_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 200")
    assert np.array_equal(quality.word_vectors(docs.repartition(7)), quality.word_vectors(docs.coalesce(1)))


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    x = np.zeros((3000, quality.FEATURES), dtype=np.float32)
    x[:, :5] = rng.normal(size=(3000, 5))
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    net = quality.fit_network(x[:2000], y[:2000], np.arange(2000) % 5 == 0)
    p = net.score(x[2000:])
    assert abs(p.mean() - y[2000:].mean()) < 0.06 and abs(p[p > 0.8].mean() - y[2000:][p > 0.8].mean()) < 0.1


def test_odd_rows_and_missing_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(3, 1), (4, None), (None, 0), (3, 1)], "doc_id long, quality int")
    rows = odd_rows(spark, "lang string, score string, n_chars long")
    for labels in (none, one):
        model = quality.fit(rows, labels)
        out = quality.score(rows, model)
        assert out.columns == ["doc_id", "text", "lang", "n_chars", "score"]
        got = out.collect()
        assert len(got) == rows.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(empty(spark), quality.fit(empty(spark), none)).collect() == []
