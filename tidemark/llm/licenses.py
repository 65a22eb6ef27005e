"""Licence scan by diagonal voting.

Every rolling word k-gram hash of every text is joined with the positions of the
same hash in the templates. A match of text position p with template position t
votes for the diagonal p - t of that template; votes are collected as a bit mask
of template positions. A phrase stands in the text where one diagonal holds all
its votes. For notices, which may be worded slightly differently, neighbouring
diagonals are merged (an inserted or dropped word shifts the diagonal) and a
span is kept if it covers enough of the notice and is not much longer than it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.textbits import LOWER, PLAIN_WORDS, binary, chunks, gram_hashes, map_batches, owners, word_hashes, word_spans

K = 2
GAP = 2
COVER = 0.7
STRETCH = 1.3

#: Base phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Opening sentences of public licence notices, at most 64 word pairs each.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
)


def _words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[buf]
    starts, ends = word_spans(low, PLAIN_WORDS)
    return word_hashes(low, starts, ends), owners(at, starts)


def grams(docs: DataFrame, id_col: str, text_col: str, k: int = K) -> DataFrame:
    """Rows (row, id, n_words, grams): the rolling k-gram hashes of each whole text; ``row`` tells repeated ids apart."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0)
            for c in chunks(binary(batch.column(1))):
                words, text = _words(c.buf, c.at)
                count = np.bincount(text, minlength=c.hi - c.lo)
                own = gram_hashes(words, k).view(np.int64)
                own = own[text[: own.size] == text[k - 1 :]] if own.size else own
                ends = np.r_[0, np.cumsum(np.maximum(count - k + 1, 0))]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(own))
                rows = pa.array(np.arange(row, row + count.size))
                row += count.size
                yield pa.RecordBatch.from_arrays([rows, ids.slice(c.lo, count.size), pa.array(count), lists], ["row", "id", "n_words", "grams"])

    return map_batches(docs.select(f"`{id_col}`", f"`{text_col}`"), run, f"row long, id {kind}, n_words long, grams array<long>")


def template_positions(spark: SparkSession, k: int = K, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Rows (gram, tid, at, size, phrase, label); their number is that of the words of the given templates."""
    rows = []
    for tid, (text, label, phrase) in enumerate([(*p, True) for p in phrases] + [(*n, False) for n in notices]):
        buf = np.frombuffer(text.encode() + b" ", dtype=np.uint8)
        words, _ = _words(buf, np.array([0, buf.size]))
        own = gram_hashes(words, k).view(np.int64).tolist()
        if not 1 <= len(own) <= 64:
            raise ValueError(f"a template needs {k} to {63 + k} words: {text!r}")
        rows += [(g, tid, at, len(own), phrase, label) for at, g in enumerate(own)]
    return spark.createDataFrame(rows, "gram long, tid int, at int, size int, phrase boolean, label string")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """Rows (row, id, n_words, tid, label, phrase, start, covered, size, span) with at least one row per text.

    ``span`` marks verified spans; ``covered`` is the share of the template found.
    """
    spark = docs.sparkSession
    table = F.broadcast(template_positions(spark, K, phrases, notices))  # a fixed table of a few hundred rows
    placed = grams(docs, id_col, text_col).select("row", "id", "n_words", F.posexplode_outer("grams").alias("pos", "gram"))
    hits = placed.join(table, "gram", "left").where("tid IS NOT NULL OR coalesce(pos, 0) = 0")
    votes = hits.groupBy("row", "tid", (F.col("pos") - F.col("at")).alias("start")).agg(
        F.first("id").alias("id"),
        F.first("n_words").alias("n_words"),
        F.first("size").alias("size"),
        F.first("phrase").alias("phrase"),
        F.first("label").alias("label"),
        F.bit_or(F.expr("shiftleft(1L, at)")).alias("mask"),
        F.max("pos").alias("last"),
        F.min("pos").alias("first"),
    )
    order = Window.partitionBy("row", "tid").orderBy("start")
    fresh = F.when(F.col("phrase") | (F.col("start") - F.lag("start").over(order) > GAP), 1).otherwise(0)
    grouped = votes.withColumn("run", fresh).withColumn("run", F.sum("run").over(order))
    merged = grouped.groupBy("row", "tid", "run").agg(
        F.first("id").alias("id"),
        F.first("n_words").alias("n_words"),
        F.first("size").alias("size"),
        F.first("phrase").alias("phrase"),
        F.first("label").alias("label"),
        F.min("start").alias("start"),
        (F.bit_count(F.bit_or("mask")) / F.first("size")).alias("covered"),
        (F.max("last") - F.min("first") + 1).alias("length"),
    )
    verified = F.when(F.col("phrase"), F.col("covered") == 1).otherwise((F.col("covered") >= COVER) & (F.col("length") <= STRETCH * F.col("size")))
    return merged.withColumn("span", F.coalesce(F.col("tid").isNotNull() & verified, F.lit(False)))


def labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null or empty text has no words and no labels. Repeated rows stay apart;
    other columns of ``docs`` play no part; an empty table gives an empty table.
    """
    spans = scan(docs, id_col, text_col)
    base, some = F.col("span") & F.col("phrase"), F.col("span")

    def listed(condition):
        return F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")

    return spans.groupBy("row").agg(
        F.first("id").alias(id_col),
        F.first("n_words").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        listed(base).alias("base_labels"),
        listed(some).alias("labels"),
        F.coalesce(F.max(F.when(some, F.col("covered"))), F.lit(0.0)).alias("score"),
    ).drop("row")
