"""Vectorised text helpers for Arrow batches: word spans and hashes over UTF-8 bytes.

Texts are handled in chunks of about ``CHUNK`` bytes, so a task needs memory for
one chunk, or for one text where a single text is longer. Chunks only bound
memory: every text is whole in its chunk.
"""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

import tidemark

CHUNK = 1 << 20
#: Bytes of a batch that are handed to an operator at once; a longer row comes alone.
CUT = 4 << 20
_PIECE = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of the words [^\x20\x09-\x0D]+.
BLANK_WORDS = np.ones(256, dtype=bool)
BLANK_WORDS[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after lower-casing A-Z.
PLAIN_WORDS = np.zeros(256, dtype=bool)
PLAIN_WORDS[0x30:0x3A] = True
PLAIN_WORDS[0x61:0x7B] = True
PLAIN_WORDS[0x80:] = True

_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_UNPRIME = np.uint64(_inverse(int(_PRIME)))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(name)
    if have is None or have.size < n:
        steps = np.full(max(n, _PIECE), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Chunk:
    """Texts ``lo`` to ``hi`` of a batch, joined by blanks; ``at[i]`` is where text lo+i begins."""

    lo: int
    hi: int
    buf: np.ndarray
    at: np.ndarray


def binary(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def chunks(texts: list[bytes | None], limit: int = CHUNK) -> Iterator[Chunk]:
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or b"") < limit):
            size += len(texts[hi] or b"") + 1
            hi += 1
        parts = [t or b"" for t in texts[lo:hi]]
        at = np.zeros(hi - lo + 1, dtype=np.int64)
        np.cumsum([len(p) + 1 for p in parts], out=at[1:])
        yield Chunk(lo, hi, np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8), at)
        lo = hi


def word_spans(buf: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (exclusive) of every run of ``mask`` bytes; ``buf`` ends with another byte."""
    inside = np.zeros(buf.size + 1, dtype=np.int8)
    inside[1:] = mask[buf]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes and its length, scrambled."""
    out = np.empty(starts.size, dtype=np.uint64)
    i = 0
    while i < starts.size:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _PIECE, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum((buf[lo:hi].astype(np.uint64) + np.uint64(1)) * _power(_PRIME, hi - lo, "up"), out=sums[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        value = (sums[b] - sums[a]) * _power(_UNPRIME, hi - lo, "down")[a]
        out[i:j] = mix(value + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word sequences that begin at each of the first n-k+1 words."""
    n = words.size - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + words[j : j + n])
    return out


def owners(at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Index of the text in which each word begins."""
    return np.searchsorted(at, starts, "right") - 1


def code_points(buf: np.ndarray) -> np.ndarray:
    """1 where a byte begins a code point."""
    return (buf & 0xC0) != 0x80


def to_points(text: bytes, positions: list[int]) -> list[int]:
    """Code-point positions of ascending byte positions."""
    if len(text) == 0 or text.isascii():
        return positions
    out, at, points = [], 0, 0
    for p in positions:
        points += len(text[at:p].decode("utf-8", "replace"))
        out.append(points)
        at = p
    return out


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of all executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(tidemark.__file__).parent
    path = os.path.join(tempfile.mkdtemp(), "tidemark.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def cut(batches: Iterator[pa.RecordBatch], limit: int = CUT) -> Iterator[pa.RecordBatch]:
    """All rows of the batches, in batches of about ``limit`` bytes: Spark's may have 64 MB, and Python objects made of them as much again."""
    for batch in batches:
        n = max(1, batch.num_rows * limit // max(batch.nbytes, 1))
        for lo in range(0, batch.num_rows, n):
            yield batch.slice(lo, n)


def small_batches(spark: SparkSession) -> None:
    """Let the session make Arrow batches of about ``CUT`` bytes: Spark builds each whole outside of the heap, once per task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)(k|m|)b?", spark.conf.get(name, None) or "", re.I)
    if not now or not 0 < int(now[1]) << {"k": 10, "m": 20, "": 0}[now[2].lower()] <= CUT:
        spark.conf.set(name, str(CUT))


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, and the C library keeps whatever lies below a block in use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow``, with this package present on the workers and batches small; an idle worker gives freed memory back."""
    ship(df.sparkSession)
    small_batches(df.sparkSession)

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(cut(batches))
        give_back()

    return df.mapInArrow(lean, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def extend(df: DataFrame, text_col: str, fields: dict[str, tuple[str, pa.DataType]], run: Callable) -> DataFrame:
    """``df`` with more columns, computed from its texts batch by batch.

    ``run(texts)`` takes the UTF-8 texts of a batch (None for null) and returns
    one sequence per new column. A column of ``df`` with the name of a new one
    is replaced; all others pass through unchanged.
    """
    base = df.select(*[f"`{c}`" for c in df.columns if c not in fields])
    names, kinds = [*base.columns, *fields], [k for _, k in fields.values()]
    at = base.columns.index(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), *(f"`{n}` {d}" for n, (d, _) in fields.items())])

    def apply(batches):
        for batch in batches:
            new = run(binary(batch.column(at)))
            made = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(new, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names)

    return map_batches(base, apply, schema)
