"""Secret scan: base patterns, and a battery of randomness tests with false-discovery control.

Base spans follow fixed patterns. The battery looks at every long token of
encoding characters, infers its encoding (hex, base32, base36, base62, base64)
and tests it for randomness: chi-squared uniformity over the encoding's
alphabet, a runs test over character classes and the lag-1 serial correlation
of the symbol values. The three p-values are combined (three times the
smallest). The null hypothesis is "random"; Benjamini-Hochberg over all tokens
of a length band, in the whole table, rejects it for ordinary text, so that the
share of true random tokens among those dismissed stays below ``q`` in every
band, although short tokens are far more common and have less power. Tokens that
are not rejected are reported as ``random``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textbits import chunks, extend, fresh, to_points, word_spans
from tidemark.session import materialize

#: The base patterns, their least lengths and the order of kinds.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "random")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24

TOKEN_CHARS = 20
#: Length bands of the false-discovery control: least length of each.
BANDS = (20, 32, 48, 96)
BINS_PER_DECADE = 8
MOST_BIN = 8 * 300

_HEX = np.zeros(256, dtype=bool)
_HEX[[*b"0123456789abcdef"]] = True
_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True

_ENCODINGS = (
    ("hex", re.compile(rb"[0-9a-f]+|[0-9A-F]+"), b"0123456789abcdef"),
    ("base32", re.compile(rb"[A-Z2-7]+"), b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", re.compile(rb"[0-9a-z]+|[0-9A-Z]+"), b"0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", re.compile(rb"[0-9A-Za-z]+"), b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", re.compile(rb"[0-9A-Za-z+/]+|[0-9A-Za-z_-]+"), b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)

SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"
CANDIDATE = "array<struct<start:bigint,end:bigint,encoding:string,n:int,p:double>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_CANDIDATE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("n", pa.int32()), ("p", pa.float64())]))


def encoding_of(token: bytes) -> tuple[str, bytes] | None:
    """The narrowest encoding of a token that mixes character classes as its random strings do."""
    digit, upper, lower = (bool(re.search(p, token)) for p in (rb"[0-9]", rb"[A-Z]", rb"[a-z]"))
    if not digit or not (upper or lower):
        return None
    for name, pattern, alphabet in _ENCODINGS:
        if pattern.fullmatch(token) and (name in ("hex", "base32", "base36") or (upper and lower)):
            return name, alphabet
    return None


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared_p(codes: np.ndarray, k: int) -> float:
    """Upper tail of Pearson's statistic against uniformity, with the moments of small samples."""
    n = codes.size
    x = float(((np.bincount(codes, minlength=k) - n / k) ** 2).sum() * k / n)
    mean, var = k - 1, 2 * (k - 1) * (n - 1) / n
    scale, dof = var / (2 * mean), 2 * mean * mean / var
    z = ((x / scale / dof) ** (1 / 3) - (1 - 2 / (9 * dof))) / math.sqrt(2 / (9 * dof))
    return 0.5 * math.erfc(z / math.sqrt(2))


def runs_p(classes: np.ndarray) -> float:
    """Two-sided runs test over several classes."""
    n = classes.size
    sizes = np.bincount(classes).astype(float)
    s2, s3 = float((sizes**2).sum()), float((sizes**3).sum())
    mean = (n * (n + 1) - s2) / n
    var = (s2 * (s2 + n * (n + 1)) - 2 * n * s3 - n**3) / (n * n * (n - 1))
    if var <= 0:
        return 0.0
    runs = 1 + int((classes[1:] != classes[:-1]).sum())
    return _two_sided((runs - mean) / math.sqrt(var))


def serial_p(codes: np.ndarray) -> float:
    """Two-sided test of the lag-1 correlation of symbol values."""
    x = codes - codes.mean()
    total = float((x * x).sum())
    if total == 0:
        return 0.0
    r = float((x[1:] * x[:-1]).sum()) / total
    return _two_sided((r + 1 / x.size) * math.sqrt(x.size))


def randomness(token: bytes) -> tuple[str, float] | None:
    """Encoding and combined p-value of a token, or None where no encoding fits."""
    body = token.rstrip(b"=")
    found = encoding_of(body)
    if found is None:
        return None
    name, alphabet = found
    table = np.zeros(256, dtype=np.int64)
    table[[*alphabet]] = np.arange(len(alphabet))
    if name in ("hex", "base36"):
        table[[*alphabet.upper()]] = np.arange(len(alphabet))
    if name == "base64":
        table[[*b"-_"]] = (62, 63)
    raw = np.frombuffer(body, dtype=np.uint8)
    classes = np.digitize(raw, (48, 58, 65, 91, 97, 123))
    codes = table[raw]
    p = 3 * min(chi_squared_p(codes, len(alphabet)), runs_p(classes), serial_p(codes))
    return name, min(1.0, max(p, 1e-300))


def base_spans(text: bytes, hexes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of base matches in bytes, by start, then kind; ``hexes`` are the hex runs."""
    found = [(a, 2, b) for a, b in hexes]
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    return sorted(found)


def _scan(texts: list[bytes | None]) -> tuple[list, list]:
    bases, candidates = [], []
    for c in chunks(texts):
        runs = {}
        for kind, mask, least in (("hex", _HEX, HEX_CHARS), ("token", _TOKEN, TOKEN_CHARS)):
            starts, ends = word_spans(c.buf, mask)
            long = ends - starts >= least
            starts, ends = starts[long], ends[long]
            owner = np.searchsorted(c.at, starts, "right") - 1
            own: dict[int, list] = {}
            for o, a, b in zip(owner.tolist(), (starts - c.at[owner]).tolist(), (ends - c.at[owner]).tolist()):
                own.setdefault(o, []).append((a, b))
            runs[kind] = own
        for k, i in enumerate(range(c.lo, c.hi)):
            text = texts[i] or b""
            spans = base_spans(text, runs["hex"].get(k, []))
            tested = []
            for a, b in runs["token"].get(k, []):
                while b < len(text) and text[b] == 61 and text[b - 2 : b] != b"==":
                    b += 1
                result = randomness(text[a:b])
                if result:
                    tested.append((a, b, *result))
            edges = sorted({p for a, _, b in spans for p in (a, b)} | {p for a, b, *_ in tested for p in (a, b)})
            point = dict(zip(edges, to_points(text, edges)))
            bases.append([{"kind": KINDS[r], "start": point[a], "end": point[b]} for a, r, b in spans])
            candidates.append([{"start": point[a], "end": point[b], "encoding": e, "n": b - a, "p": p} for a, b, e, p in tested])
    return bases, candidates


def scan(docs: DataFrame, text_col: str = "text", base: str = "base", candidates: str = "candidates") -> DataFrame:
    """Add the base spans and the tested tokens (position, encoding, length, p-value) of every whole text.

    Positions are code points, ends exclusive. A null text counts as empty and
    has no spans. Rows (repeated ones too) and other columns are kept; a column
    named like a new one is replaced; an empty table gives an empty table.
    """
    return extend(docs, text_col, {base: (SPAN, _SPAN), candidates: (CANDIDATE, _CANDIDATE)}, _scan)


def band(n: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(BANDS):
        out = F.when(n >= least, F.lit(i)).otherwise(out)
    return out


def _bin(p: Column) -> Column:
    return F.least(F.lit(MOST_BIN), F.floor(-F.log10(p) * BINS_PER_DECADE).cast("int"))


def dismissed_from(scanned: DataFrame, q: float = 0.1, candidates: str = "candidates") -> dict[int, int]:
    """For each length band, the p-value bin from which randomness is rejected (none: not in the result).

    One count per band and bin of the whole table leaves the executors, at most
    ``len(BANDS) * MOST_BIN`` rows before the rule and ``len(BANDS)`` after it.
    """
    tested = scanned.select(F.explode(candidates).alias("c")).select(band(F.col("c.n")).alias("band"), _bin(F.col("c.p")).alias("bin"))
    counted = tested.groupBy("band", "bin").agg(F.count("*").alias("n"))
    at_most = F.expr("sum(n) OVER (PARTITION BY band ORDER BY bin DESC)")
    total = F.expr("sum(n) OVER (PARTITION BY band)")
    rule = counted.select("band", "bin", at_most.alias("k"), total.alias("m")).where(
        F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE) * F.col("m") <= q * F.col("k")
    )
    return {r["band"]: r["bin"] for r in rule.groupBy("band").agg(F.min("bin").alias("bin")).collect()}


def random_spans(limits: dict[int, int], base: str = "base", candidates: str = "candidates") -> Column:
    """Tokens not dismissed and not overlapping a base span, as spans of kind ``random``."""
    def kept(c: Column) -> Column:
        most = F.lit(MOST_BIN + 1)
        for b, at in limits.items():
            most = F.when(band(c["n"]) == b, F.lit(at)).otherwise(most)
        return (_bin(c["p"]) < most) & ~F.exists(base, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))

    return F.transform(
        F.filter(candidates, kept), lambda c: F.struct(F.lit("random").alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    )


def all_spans(limits: dict[int, int], base: str = "base", candidates: str = "candidates") -> Column:
    """Base and random spans by start, then kind."""
    def key(s: Column) -> Column:
        order = F.lit(0)
        for i, k in enumerate(KINDS):
            order = F.when(s["kind"] == k, F.lit(i)).otherwise(order)
        return F.struct(s["start"].alias("start"), order.alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))

    both = F.array_sort(F.transform(F.concat(F.col(base), random_spans(limits, base, candidates)), key))
    return F.transform(both, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, text_col: str = "text", q: float = 0.1, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) with ``base`` and ``spans``, from one pass over the texts.

    The scan's small result is written once; limits and spans come from it.
    """
    names = [c for c in (keep or docs.columns) if c not in ("base", "spans")]
    scanned = scan(docs, text_col).select(*[f"`{c}`" for c in names], "base", "candidates")
    scanned = materialize(scanned, "secrets")
    limits = dismissed_from(scanned, q)
    return scanned.select(*[f"`{c}`" for c in names], "base", all_spans(limits).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", q: float = 0.1) -> DataFrame:
    """``docs`` with every secret span of the text replaced by ``mask``; rows, columns and their order stay.

    Overlapping spans are replaced together. Texts are scanned twice, first for
    the limits and then for the spans, so that no copy of them is written.
    """
    limits = dismissed_from(scan(docs.select(f"`{text_col}`"), text_col), q)

    def run(texts: list[bytes | None]) -> list[list[str | None]]:
        out = []
        for text, base, tested in zip(texts, *_scan(texts)):
            spans = sorted([(s["start"], s["end"]) for s in base] + reported(base, tested, limits))
            whole = None if text is None else text.decode("utf-8", "replace")
            out.append(masked(whole, spans, mask) if spans else whole)
        return [out]

    (clean,) = fresh(docs, "_clean")
    made = extend(docs, text_col, {clean: ("string", pa.string())}, run)
    return made.select(*[(F.col(clean).alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns])


def reported(base: list[dict], tested: list[dict], limits: dict[int, int]) -> list[tuple[int, int]]:
    """(start, end) of the tokens that ``random_spans`` keeps: not dismissed by the limits, not overlapping a base span."""
    joined: list[list[int]] = []
    for s in sorted(base, key=lambda s: s["start"]):
        if joined and s["start"] <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], s["end"])
        else:
            joined.append([s["start"], s["end"]])
    starts = [s for s, _ in joined]
    out = []
    for c in tested:
        own = max(i for i, least in enumerate(BANDS) if i == 0 or c["n"] >= least)
        at = min(MOST_BIN, math.floor(-math.log10(c["p"]) * BINS_PER_DECADE))
        before = bisect_left(starts, c["end"]) - 1
        if at < limits.get(own, MOST_BIN + 1) and (before < 0 or joined[before][1] <= c["start"]):
            out.append((c["start"], c["end"]))
    return out


def masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """``text`` with its spans, sorted by start, replaced; overlapping ones as one."""
    parts, done = [], 0
    for start, end in spans:
        if start >= done:
            parts += [text[done:start], mask]
        done = max(done, end)
    return "".join([*parts, text[done:]])
