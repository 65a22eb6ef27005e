from __future__ import annotations

from collections import Counter

import corpus_pipeline as c
from tests.llm.helpers import empty, jaccard_components, odd_rows, sha
from tidemark.llm import bpe, mixing, secrets
from tidemark.llm.queries import documents, vocabulary


def test_stages_one_by_one(spark, sf, tmp_path):
    docs = documents(spark, sf)
    columns, seen = docs.columns, {"documents": docs}
    for name, stage in c.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = seen[name] = spark.read.parquet(path)
        if name != c.STAGES[-1][0]:
            assert docs.columns == columns
    good = {r["doc_id"]: r["text"] for r in seen["quality"].collect()}
    assert 0.7 * seen["documents"].count() < len(good) < seen["documents"].count()
    want = jaccard_components(sorted(good.items()))
    single = {r["doc_id"]: r["text"] for r in seen["near_duplicates"].collect()}
    assert set(single) == {i for i, (n, x) in want.items() if n == 0 or x == i}
    clean = {r["doc_id"]: r for r in seen["secrets"].collect()}
    assert set(clean) == set(single)
    limits = secrets.find(seen["near_duplicates"]).collect()
    for r in limits:
        text, out = r["text"], clean[r["doc_id"]]
        assert (out["text"] == text) == (not r["spans"]) and out["n_chars"] == len(out["text"])
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(seen["secrets"]).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in seen["mixing"].collect()) == Counter(copies)
    codec = bpe.Codec(bpe.read_vocabulary(vocabulary()))
    final = docs.collect()
    assert len(final) == sum(copies.values())
    for r in final:
        assert codec.decode(r["ids"]) == clean[r["doc_id"]]["text"] and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == sha(clean[r["doc_id"]]["text"])


def test_run_gives_the_last_stage(spark, sf):
    out = c.run(spark, sf)
    assert out.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "decoded_sha256"] and out.count() > 0


def test_empty_table(spark, sf):
    docs = empty(spark)
    for _, stage in c.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.collect() == []


INTERNAL = [
    "_score", "_h", "_class", "_id", "_of", "_stays", "_row", "_base", "_candidates", "_spans", "_source", "_whole", "_cut", "_extra", "_copy", "_plan",
    "_size", "_u", "class", "comp", "base", "spans", "score", "ids", "size", "_doc", "_label", "_text", "_calibrate", "_x", "decoded",
]


def test_odd_rows_with_every_internal_name(spark, sf):
    """Null, empty, blank, long and repeated rows through all stages, with extra columns named like those of the operators."""
    good = documents(spark, sf).limit(120)
    rows = good.unionByName(odd_rows(spark).select(*good.columns)).unionByName(good.limit(3)).selectExpr("*", *[f"7 AS `{n}`" for n in INTERNAL])
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    docs, columns = rows, rows.columns
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, sf)
        kept = out.collect()
        assert out.columns == columns, name
        assert all(r[n] == 7 for r in kept for n in INTERNAL), name
        docs = spark.createDataFrame(kept, rows.schema)
    final = c.STAGES[-1][1](spark, docs, sf).collect()
    assert len(final) == docs.count() > 0
    # any stage alone bears the odd rows; those without words are no near copies and take no part of the mix
    odd = odd_rows(spark).selectExpr("*", *[f"7 AS `{n}`" for n in INTERNAL])
    for name, stage in c.STAGES[1:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns and all(r[n] == 7 for r in out.collect() for n in INTERNAL), name
    assert all(r["text"].strip() for r in c.mix_sources(spark, odd, sf).collect())
