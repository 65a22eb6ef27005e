from __future__ import annotations

import random
import re
import string

from tests.llm.helpers import empty, odd_rows, sha
from tidemark.llm import secrets
from tidemark.llm.queries import op4

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def plain(text: str | None) -> list[tuple]:
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
    return sorted(found)


def listed(found) -> str:
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in found)


def test_query_base(spark, sf, texts):
    got = {r["doc_id"]: r for r in op4(spark, sf).collect()}
    for i, t in texts:
        want = plain(t)
        assert got[i]["base_sha256"] == sha(listed(want))
        assert [got[i][f"n_{k}"] for k in secrets.KINDS[:3]] == [sum(r == k for _, r, _ in want) for k in range(3)]
        assert set(listed(want).split(",")) <= set(got[i]["spans"].split(","))


def test_random_strings_against_patterns(spark):
    rng = random.Random(4)
    parts = ["token", "PassWord", "secret", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH01234567", "é", "deadbeef01", ".", "Kx-_+/", "ſecret=abcdef"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(14)))) for i in range(3000)]
    for _, t in rows:
        point = [(len(t.encode()[:a].decode()), k, len(t.encode()[:b].decode())) for a, k, b in secrets.base_spans(t.encode(), [])]
        assert point == [x for x in plain(t) if x[1] != 2], t


def test_battery_tells_random_from_text():
    rng = random.Random(1)
    alphabets = {"hex": "0123456789abcdef", "base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/"}
    ps = {}
    for name, alphabet in alphabets.items():
        found = [secrets.randomness("".join(rng.choice(alphabet) for _ in range(48)).encode()) for _ in range(200)]
        ps[name] = [p for x in found if x for _, p in [x]]
        assert sum(p < 0.05 for p in ps[name]) / len(ps[name]) < 0.12
    for text in (b"Version2019InternationalConference", b"aaaaaaaaaaaaaaaaaaaaaaaa1", b"Chapter1Section2Paragraph3Sentence4", b"abcabcabcabcabcabcabcabc123123"):
        assert secrets.randomness(text)[1] < 0.01
    assert secrets.randomness(b"onlylowercaselettersinthisone") is None


def test_random_tokens_are_found_and_text_is_dismissed(spark):
    rng = random.Random(3)
    token = lambda: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    secretive = [(i, f"é {token()} end") for i in range(40)]
    plain_rows = [(100 + i, f"see Chapter{i % 10}SectionTwoParagraphThree and Version{i % 7}InternationalConference") for i in range(200)]
    found = secrets.find(spark.createDataFrame(secretive + plain_rows, "doc_id long, text string")).collect()
    spans = {r["doc_id"]: [r["text"][s["start"] : s["end"]] for s in r["spans"]] for r in found}
    assert sum(spans[i] == [t.split()[1]] for i, t in secretive) >= 34  # some random tokens look ordered by chance
    assert not any(spans[i] for i, _ in plain_rows)


def test_redact(spark):
    rows = [(1, 'é token = "abcdef123" x ' + "0123456789abcdef" * 2 + "!"), (2, None), (3, ""), (4, "nothing"), (5, "AKIA" + "A1" * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS base", "2 AS spans", "3 AS candidates")
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {1: 'é [SECRET]" x [SECRET]!', 2: None, 3: "", 4: "nothing", 5: "[SECRET]"}


def test_odd_rows(spark):
    rows = odd_rows(spark)
    assert secrets.find(rows).count() == rows.count()
    assert secrets.find(empty(spark)).collect() == [] and secrets.redact(empty(spark)).collect() == []
    assert sorted(map(repr, secrets.redact(rows).collect())) == sorted(map(repr, rows.collect()))


def test_redact_keeps_columns_of_any_name_and_long_texts(spark):
    names = ["_base", "_candidates", "_spans", "__base", "start", "end"]
    many = " ".join(f"é {i} password=abcdef{i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, many), (2, "AKIA" + "B2" * 10), (3, None)], "doc_id long, text string").selectExpr(*[f"7 AS `{c}`" for c in names], "*")
    out = secrets.redact(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(r[c] == 7 for r in got.values() for c in names)
    assert got[1]["text"] == " ".join(f"é {i} [SECRET]" for i in range(20_000)) and got[2]["text"] == "[SECRET]" and got[3]["text"] is None


def test_masked_joins_overlapping_spans():
    assert secrets.masked("0123456789", [(1, 4), (2, 6), (6, 7), (9, 9)], "#") == "0##78#9"


def test_redaction_masks_the_spans_that_are_found(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = random.Random(2)
    odd = [(10**6 + i, " ".join("".join(rng.choice(string.ascii_letters + string.digits) for _ in range(rng.randrange(18, 60))) + "=abc" * (j % 2) for j in range(5))) for i in range(60)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    spans = {r["doc_id"]: (r["text"], [(s["start"], s["end"]) for s in r["spans"]]) for r in secrets.find(docs).collect()}
    assert any(s for _, s in spans.values())
    assert {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()} == {i: secrets.masked(t, s, "[SECRET]") for i, (t, s) in spans.items()}
