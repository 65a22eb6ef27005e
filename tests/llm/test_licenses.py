from __future__ import annotations

import re

from tests.llm.helpers import LOWER, PLAIN_WORD, empty, odd_rows
from tidemark.llm import licenses


def plain(text: str | None):
    words = PLAIN_WORD.findall((text or "").translate(LOWER))
    places = []
    for phrase, label in licenses.PHRASES:
        own = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    starts = [p for p, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def base(r):
    return r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]


def test_base_columns(spark, sf, texts):
    got = {r["doc_id"]: base(r) for r in licenses.labels(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == {i: plain(t) for i, t in texts}


def test_notices_with_changed_words(spark):
    notice = licenses.NOTICES[0][0].split()
    rows = [
        (1, "x y " + " ".join(notice) + " z"),
        (2, " ".join(notice[:6] + ["inserted", "words"] + notice[6:])),
        (3, " ".join(notice[:6])),
        (4, " filler ".join(notice)),
        (5, "CC-BY, then CC BY; the MIT License! mit license cc by cc by"),
        (6, " ".join(reversed(notice))),
    ]
    got = {r["doc_id"]: r for r in licenses.labels(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "mit" and got[1]["score"] == 1.0 and got[1]["n_base"] == 0
    assert got[2]["labels"] == "mit" and got[2]["score"] < 1
    assert [got[i]["labels"] for i in (3, 4, 6)] == ["", "", ""]
    assert base(got[5]) == plain(rows[4][1]) and got[5]["n_base"] == 6


def test_odd_rows(spark):
    rows = odd_rows(spark, "lang string, source string, pos int")
    got = sorted(map(repr, (base(r) for r in licenses.labels(rows).collect())))
    assert got == sorted(repr(plain(r["text"])) for r in rows.collect())
    assert licenses.labels(empty(spark)).collect() == []


def test_templates_are_lower_case_words():
    for text, _ in (*licenses.PHRASES, *licenses.NOTICES):
        assert re.fullmatch(r"[a-z0-9]+( [a-z0-9]+)+", text)
