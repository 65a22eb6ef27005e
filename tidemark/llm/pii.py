"""Personal data: base patterns, and a skip-chain conditional random field over candidate tokens.

Nodes of a document are its base matches and further tokens that could be
personal data: digit groups without a plus sign, written-out addresses
("name (at) host (dot) org") and repetitions of an address's local part. Nodes
are chained in text order. Skip edges tie nodes with the same key (last ten
digits, dotted address, local part) to one node of that key, so a value repeated
n times has n edges and every mention is as near to the others as any. Base
matches are evidence with a fixed label, also for the node of their key. Loopy
message passing over chain and skip edges, until the messages stand still, gives
each free node its marginals; a node whose best label is not O with at least
``least`` probability is reported, so that all mentions of one value get one label.

The potentials are counted by Spark over all documents: features per label,
labels of neighbours, and how often base matches of the same key agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textbits import extend, map_batches, to_points
from tidemark.session import materialize

#: Kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(rb"(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

DIGITS = re.compile(rb"(?<![0-9+])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}")
WRITTEN = re.compile(
    rb"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]+)+"
)
ANY_DIGIT = re.compile(rb"[0-9]")
#: A document's messages stand still when none changes by more; rounds end at the latest after four times its nodes (a message
#: halved each round moves an edge in about two) and these.
TOLERANCE, ROUNDS = 1e-5, 100
#: Features that no base match can have: counts over base labels say nothing about them, their skip edges decide.
NEUTRAL = ("written", "local")
#: Log potential of the labels that evidence rules out.
ABSENT = -50.0

NODE = "array<struct<label:int,base:boolean,start:bigint,end:bigint,feature:string,key:string>>"
_NODE = pa.list_(
    pa.struct(
        [("label", pa.int32()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("feature", pa.string()), ("key", pa.string())]
    )
)
SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def emails(text: bytes) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their @ signs."""
    done, at = 0, text.find(b"@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find(b"@", max(at + 1, done))


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(token: bytes) -> bytes:
    return bytes(c for c in token if 48 <= c <= 57)


def _part_ok(part: bytes) -> bool:
    part = part.lstrip(b"0")
    return len(part) <= 3 and int(part or b"0") <= 255


def base_matches(text: bytes) -> list[tuple[int, int, int]]:
    """(start, label, end) of all base matches in bytes, by start, then kind."""
    found = [(a, 1, b) for a, b in emails(text)] if b"@" in text else []
    if ANY_DIGIT.search(text):
        if b"." in text:
            found += [(m.start(), 2, m.end()) for m in IP.finditer(text) if all(map(_part_ok, m.group().split(b".")))]
        for m in CARD.finditer(text):
            own = _digits(m.group())
            if len(own) <= 19 and luhn(own):
                found.append((m.start(), 3, m.end()))
        if b"+" in text:
            found += [(m.start(), 4, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(found)


def _shape(token: bytes) -> str:
    """Number of digits (of a number with country code: without it) and the signs between them."""
    n = len(_digits(token))
    if token.startswith(b"+"):
        n = min(n, 10)
        token = token[1:]
    failing = "x" if 14 <= n <= 19 and not luhn(_digits(token)) else ""
    return f"d{min(n, 24)}{failing}" + "".join(s for s in " -.(" if s.encode() in token)


def _key(token: bytes, label: int) -> str:
    if label == 1:
        return "e" + token.split(b"@")[0].decode().lower()
    if label == 2:
        return "i" + token.decode()
    return "d" + _digits(token)[-10:].decode()


def nodes_of(text: bytes) -> list[tuple[int, int, int, bool, str, str]]:
    """(start, label, end, base, feature, key) of all nodes in bytes, by start, then label."""
    out = [(a, r, b, True, "address" if r == 1 else _shape(text[a:b]), _key(text[a:b], r)) for a, r, b in base_matches(text)]
    taken = sorted((a, b) for a, _, b, *_ in out)
    free: list[tuple[int, int, str, str]] = []
    if ANY_DIGIT.search(text):
        for m in DIGITS.finditer(text):
            token = m.group()
            free.append((m.start(), m.end(), _shape(token), "i" + token.decode() if token.count(b".") == 3 and token.replace(b".", b"").isdigit() else _key(token, 0)))
    low = text.lower() if (b"at)" in text or b"at]" in text or b"AT)" in text) else b""
    for m in WRITTEN.finditer(low):
        free.append((m.start(), m.end(), "written", "e" + re.split(rb"\x20?[\[(]at", m.group())[0].decode().lower()))
    for local in sorted({text[a:b].split(b"@")[0] for a, r, b, *_ in out if r == 1}):
        if len(local) >= 6 and re.search(rb"[0-9._]", local):
            at = text.find(local)
            while at >= 0:
                end = at + len(local)
                if not (at and text[at - 1] in LOCAL) and not (end < len(text) and text[end] in LOCAL):
                    free.append((at, end, "local", "e" + local.decode().lower()))
                at = text.find(local, end)
    last, i = 0, 0
    for a, b, feature, key in sorted(free, key=lambda n: (n[0], -n[1])):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= last and not (i < len(taken) and taken[i][0] < b):
            out.append((a, 0, b, False, feature, key))
            last = b
    return sorted(out)


def _scan(texts: list[bytes | None]) -> list:
    rows = []
    for text in texts:
        text = text or b""
        own = nodes_of(text)
        edges = sorted({p for n in own for p in (n[0], n[2])})
        point = dict(zip(edges, to_points(text, edges)))
        rows.append([{"label": r, "base": base, "start": point[a], "end": point[b], "feature": f, "key": k} for a, r, b, base, f, k in own])
    return [rows]


def scan(docs: DataFrame, text_col: str = "text", out: str = "nodes") -> DataFrame:
    """Add the nodes of every whole text (null: none); rows and other columns are kept, a column named ``out`` is replaced."""
    return extend(docs, text_col, {out: (NODE, _NODE)}, _scan)


@dataclass
class Potentials:
    """Logarithms: emission of each feature by label, transition between neighbours, bonus of equal labels on a skip edge."""

    emission: dict[str, np.ndarray]
    transition: np.ndarray
    agreement: float


def train(scanned: DataFrame, nodes: str = "nodes") -> Potentials:
    """Potentials from the counts of all documents. Features and labels are few by construction, so few rows reach the driver."""
    rows = scanned.select(F.explode(nodes).alias("n")).groupBy(F.col("n.feature").alias("f"), F.col("n.label").alias("l")).agg(F.count("*").alias("n"))
    total = np.full(len(LABELS), 0.5)
    counts: dict[str, np.ndarray] = {}
    for r in rows.collect():
        counts.setdefault(r["f"], np.full(len(LABELS), 0.05))[r["l"]] += r["n"]
        total[r["l"]] += r["n"]
    prior = np.log(total / total.sum())
    emission = {f: prior + np.log(c / (total + 0.05 * (len(counts) + 1))) for f, c in counts.items()}
    pairs = scanned.select(
        F.explode(F.zip_with(F.expr(f"slice({nodes}, 1, greatest(size({nodes}) - 1, 0))"), F.expr(f"slice({nodes}, 2, greatest(size({nodes}) - 1, 0))"), lambda a, b: F.struct(a["label"].alias("a"), b["label"].alias("b"), (a["base"] & b["base"] & (a["key"] == b["key"])).alias("same")))).alias("p")
    )
    found = pairs.groupBy("p.a", "p.b", "p.same").agg(F.count("*").alias("n")).collect()
    follow = np.full((len(LABELS), len(LABELS)), 1.0)
    agree = [1.0, 1.0]
    for r in found:
        follow[r["a"], r["b"]] += r["n"]
        if r["same"]:
            agree[r["a"] == r["b"]] += r["n"]
    follow /= follow.sum()
    transition = np.log(follow / np.outer(follow.sum(1), follow.sum(0)))
    # at least e**4, so that a tie of values counts where no repeated base match was seen
    return Potentials(emission, np.clip(transition, -1.0, 1.0), max(4.0, float(np.log(agree[1] / agree[0]))))


def marginals(
    unary: np.ndarray, left: np.ndarray, right: np.ndarray, pair: np.ndarray, rounds: int | None = None, group: np.ndarray | None = None
) -> np.ndarray:
    """Sum-product on a graph with cycles: unary log potentials (n, L), edges left→right with log potentials (e, L, L).

    ``group`` (ascending; default: all one) numbers the parts without edges between them. Each part stops by itself, when its
    messages stand still or after ``rounds`` rounds (default: four times its nodes and ``ROUNDS``), so no part's result depends on another.
    """
    n, size = unary.shape
    group = np.zeros(n, dtype=np.int64) if group is None else group
    most = 4 * np.bincount(group, minlength=1) + ROUNDS if rounds is None else np.full(int(group.max(initial=0)) + 1, rounds)
    message = np.zeros((2 * left.size, size))
    source, target = np.r_[left, right], np.r_[right, left]
    own = group[target]
    moving = np.arange(left.size)  # edges of the parts that go on
    done = 0
    while moving.size:
        both = np.r_[moving, moving + left.size]
        back = np.r_[moving + left.size, moving]
        nodes, at = np.unique(target[both], return_inverse=True)
        belief = unary[nodes]
        np.add.at(belief, at, message[both])
        # every source is a target of the edge's other direction
        out = belief[np.roll(at, moving.size)] - message[back]
        scores = out[:, :, None] + np.concatenate([pair[moving], pair[moving].transpose(0, 2, 1)])
        top = scores.max(axis=1, keepdims=True)
        new = np.log(np.exp(scores - top).sum(axis=1)) + top[:, 0]
        new -= new.max(axis=1, keepdims=True)
        new = 0.5 * message[both] + 0.5 * new
        change = np.zeros(most.size)
        np.maximum.at(change, own[both], np.abs(new - message[both]).max(axis=1))
        message[both] = new
        done += 1
        goes_on = (change > TOLERANCE) & (done < most)
        moving = moving[goes_on[own[moving]]]
    belief = unary.copy()
    np.add.at(belief, target, message)
    belief = np.exp(belief - belief.max(axis=1, keepdims=True))
    return belief / belief.sum(axis=1, keepdims=True)


def infer(documents: list[list[dict]], potentials: Potentials, least: float) -> list[list[tuple[int, int, int]]]:
    """(start, label, end) of the reported free nodes of each document; all documents form one graph without edges between them."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    nodes: list[tuple[int, dict]] = []
    unary, group, left, right, kind = [], [], [], [], []
    for d, own in enumerate(documents):
        if all(n["base"] for n in own):
            continue
        first = len(unary)
        mentions: dict[str, list[int]] = {}
        for i, n in enumerate(own, first):
            row = np.zeros(len(LABELS))
            if n["base"]:
                row[:] = ABSENT
                row[n["label"]] = 0.0
            elif n["feature"] not in NEUTRAL:
                row = potentials.emission.get(n["feature"], row)
            unary.append(row)
            nodes.append((i, n | {"doc": d}))
            mentions.setdefault(n["key"], []).append(i)
            if i > first:
                left.append(i - 1)
                right.append(i)
                kind.append(0)
        for found in mentions.values():
            known = np.bincount([own[i - first]["label"] for i in found if own[i - first]["base"]], minlength=len(LABELS))
            free = [i for i in found if not own[i - first]["base"]]
            if len(found) < 2 or not free:
                continue
            left += [len(unary)] * len(free)
            right += free
            kind += [1] * len(free)
            unary.append(np.where(known > 0, np.log(np.maximum(known, 1)), ABSENT) if known.any() else np.zeros(len(LABELS)))
        group += [d] * (len(unary) - first)
    if not unary:
        return out
    tables = np.stack([potentials.transition, potentials.agreement * np.eye(len(LABELS))])
    edges = [np.array(x, dtype=np.int64) for x in (left, right)]
    found = marginals(np.stack(unary), *edges, tables[np.array(kind, dtype=np.int64)], group=np.array(group, dtype=np.int64))
    for i, n in nodes:
        best = int(found[i].argmax())
        if not n["base"] and best and found[i, best] >= least:
            out[n["doc"]].append((n["start"], best, n["end"]))
    return out


def label(scanned: DataFrame, potentials: Potentials, nodes: str = "nodes", out: str = "spans", least: float = 0.7) -> DataFrame:
    """Add all spans (base and inferred) by start, then kind, as ``out``."""
    shared = scanned.sparkSession.sparkContext.broadcast(potentials)
    names = [c for c in scanned.columns if c != out]
    at = names.index(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            documents = [n or [] for n in batch.column(at).to_pylist()]
            extra = infer(documents, shared.value, least)
            spans = [sorted([(n["start"], n["label"], n["end"]) for n in own if n["base"]] + more) for own, more in zip(documents, extra)]
            rows = [[{"kind": LABELS[r], "start": a, "end": b} for a, r, b in own] for own in spans]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _SPAN)], [*names, out])

    base = scanned.select(*[f"`{n}`" for n in names])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), f"`{out}` {SPAN}"])
    return map_batches(base, run, schema)


def base_spans(nodes: str = "nodes") -> Column:
    names = F.array(*map(F.lit, LABELS))
    return F.transform(
        F.filter(nodes, lambda n: n["base"]),
        lambda n: F.struct(F.element_at(names, n["label"] + 1).alias("kind"), n["start"].alias("start"), n["end"].alias("end")),
    )


def find(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, least: float = 0.7) -> DataFrame:
    """The columns ``keep`` (default: all) with ``base`` and ``spans`` of every whole text.

    Positions are code points, ends exclusive. A null text has no spans; rows
    (repeated ones too) are kept; an empty table gives an empty table. Texts are read once; their
    nodes are written and serve for the counts and for the inference.
    """
    keep = [c for c in (keep or docs.columns) if c not in ("nodes", "base", "spans")]
    scanned = materialize(scan(docs, text_col).select(*[f"`{c}`" for c in keep], "nodes"), "pii")
    labelled = label(scanned, train(scanned), least=least)
    return labelled.select(*[f"`{c}`" for c in keep], base_spans().alias("base"), "spans")
