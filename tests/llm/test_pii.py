from __future__ import annotations

import random
import re

import numpy as np

from tests.llm.helpers import empty, odd_rows, sha
from tidemark.llm import pii
from tidemark.llm.queries import op6

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def plain(text: str | None) -> list[tuple]:
    t = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m)) <= 15]
    return sorted(found)


def listed(found) -> str:
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in found)


def test_query_base(spark, sf, texts):
    got = {r["doc_id"]: r for r in op6(spark, sf).collect()}
    for i, t in texts:
        want = plain(t)
        assert got[i]["base_sha256"] == sha(listed(want))
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(r == k for _, r, _ in want) for k in range(4)]
        assert set(listed(want).split(",")) <= set(got[i]["spans"].split(","))


def test_random_strings():
    rng = random.Random(3)
    for alphabet in ("ab1.2@+-(5 )409 é,", "0123456789 -", "1.25 ", "a@.b"):
        for _ in range(6000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
            found = [(len(t.encode()[:a].decode()), k - 1, len(t.encode()[:b].decode())) for a, k, b in pii.base_matches(t.encode())]
            assert found == plain(t), t
            pii.nodes_of(t.encode())


def test_repeated_values_get_the_label_of_their_first_mention(spark):
    text = "call +1 (499) 555-6503 or (499) 555-6503; mail jo.smith7@ex.example.com, jo.smith7 or jo.smith7 (at) ex (dot) example.com, order 1234567"
    rows = [(1, text), (2, "order 1234567 and (499) 555-6503 x")]
    got = {r["doc_id"]: [(s["kind"], r["text"][s["start"] : s["end"]]) for s in r["spans"]] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert ("phone", "(499) 555-6503") in got[1] and ("email", "jo.smith7") in got[1]
    assert ("email", "jo.smith7 (at) ex (dot) example.com") in got[1]
    assert not any("1234567" in t for _, t in got[1])


def test_all_mentions_get_the_label_however_far(spark):
    local = "; then ".join(["mail jo.smith7@ex.example.com", *["jo.smith7"] * 25, *["jo.smith7 (at) ex (dot) example.com"] * 25])
    phone = "; then ".join(["(499) 555-6503"] * 25 + ["call +1 (499) 555-6503"] + ["(499) 555-6503"] * 25)
    others = "; ".join(f"+1 (212) 555-{k}" for k in range(1000, 1200))
    rows = [(1, local), (2, phone), (3, "order 1234567 " * 50), (4, others)]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [s["kind"] for s in got[1]] == ["email"] * 51
    assert [s["kind"] for s in got[2]] == ["phone"] * 51
    assert got[3] == []


def test_far_mentions_without_other_evidence():
    own = [{"label": 1, "base": True, "start": 0, "end": 1, "feature": "address", "key": "ex"}]
    own += [{"label": 0, "base": False, "start": i, "end": i + 1, "feature": "local", "key": "ex"} for i in range(1, 51)]
    for agreement in (4.0, 7.0, 10.0):
        flat = pii.Potentials({}, np.zeros((5, 5)), agreement)
        alone = pii.infer([own], flat, 0.7)
        assert alone == [[(i, 1, i + 1) for i in range(1, 51)]]
        assert pii.infer([own[:3], own, own[1:]], flat, 0.7)[1] == alone[0]


def test_messages_run_along_a_long_chain():
    n = 300
    unary = np.zeros((n, 2))
    unary[0] = 0.0, -50.0
    at, pair = np.arange(n - 1), np.repeat(10.0 * np.eye(2)[None], n - 1, axis=0)
    found = pii.marginals(unary, at, at + 1, pair)
    assert np.allclose(found[:, 0], 0.5 + 0.5 * np.tanh(5.0) ** np.arange(n), atol=1e-3)


def test_marginals_of_a_tree_are_exact():
    rng = np.random.default_rng(0)
    unary, pair = rng.normal(size=(4, 3)), rng.normal(size=(3, 3, 3))
    left, right = np.array([0, 1, 1]), np.array([1, 2, 3])
    joint = np.zeros((3, 3, 3, 3))
    for x in np.ndindex(joint.shape):
        joint[x] = np.exp(sum(unary[i, x[i]] for i in range(4)) + sum(pair[e, x[a], x[b]] for e, (a, b) in enumerate(zip(left, right))))
    joint /= joint.sum()
    want = np.stack([joint.sum(axis=tuple(j for j in range(4) if j != i)) for i in range(4)])
    assert np.allclose(pii.marginals(unary, left, right, pair, rounds=60), want, atol=1e-6)


def test_long_runs_take_linear_time():
    for t in (b"1" * 200_000, b"a" * 200_000 + b"@", b"+1" + b"(" * 100_000, b"1." * 100_000, b"1 " * 100_000, b"x@" * 50_000):
        pii.nodes_of(t)


def test_odd_rows(spark):
    rows = odd_rows(spark, "nodes string, spans string, base long")
    assert pii.find(rows).count() == rows.count()
    assert pii.find(empty(spark)).collect() == []
