"""Byte-level BPE encoding and decoding with a public vocabulary file.

Texts are split by the vocabulary's word pattern. Each distinct word is encoded
once per task and kept in a bounded table; words that are not in the table are
collected and merged together: the symbols of all of them lie in one flat numpy
array, every round looks up all neighbouring pairs by binary search over the
sorted pair keys and merges, in each word, every pair of that word's lowest rank.
The vocabulary file's path is a parameter and its bytes travel with the task.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.textbits import map_batches

#: The word pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS = 200_000
FLUSH_WORDS = 20_000
GROUP_CHARS = 1 << 18
NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte value in a byte-level vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in printable:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


#: The same pattern for texts of ASCII and Latin-1 letters only, which the standard library matches faster.
_LATIN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\t-\r A-Za-zÀ-ÖØ-öø-ÿ0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)
_OTHER = re.compile(r"[^\t-\r -~À-ÖØ-öø-ÿ]")


def gather(store: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices store[begin : begin + size] of all rows, one after the other."""
    ends = np.cumsum(sizes)
    shift = np.repeat(begin - ends + sizes, sizes)
    return store[shift + np.arange(shift.size)]


def _table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


def _joined(store: np.ndarray, begin: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> Iterator[bytes]:
    own = sizes[ids]
    flat = gather(store, begin[ids], own).tobytes()
    at = np.r_[0, np.cumsum(own)][np.r_[0, np.cumsum(counts)]].tolist()
    for a, b in zip(at, at[1:]):
        yield flat[a:b]


def groups(texts: list[str], size: int = GROUP_CHARS) -> Iterator[list[str]]:
    """Consecutive texts of about ``size`` characters together; a longer text is its own group."""
    own, total = [], 0
    for text in texts:
        if own and total + len(text) > size:
            yield own
            own, total = [], 0
        own.append(text)
        total += len(text)
    if own:
        yield own


class Codec:
    """Encoder and decoder of one vocabulary file (JSON form)."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.byte_id = np.array([vocab[s] for s in symbols], dtype=np.int64)
        back = {s: b for b, s in enumerate(symbols)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces: dict[int, bytes] = {i: bytes(back[c] for c in s) for s, i in vocab.items() if i not in self.special.values()}
        self.pieces.update({i: s.encode() for s, i in self.special.items()})
        self.base = max(self.pieces) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.words = regex.compile(PATTERN)
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self.piece_bytes, self.piece_begin, self.piece_size = _table([self.pieces.get(i, b"") for i in range(self.base)])
        self.decimal_bytes, self.decimal_begin, self.decimal_size = _table([b"%d," % i for i in range(self.base)])
        self.forget()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, NONE where the pair does not merge."""
        wanted = left * self.base + right
        at = np.searchsorted(self.keys, wanted)
        at[at == self.keys.size] = 0
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words in one flat array, and each word's number of ids."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        ids = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        owner = np.repeat(np.arange(lengths.size), lengths)
        rank = np.full(ids.size, NONE, dtype=np.int64)
        same = np.flatnonzero(owner[1:] == owner[:-1])
        rank[same] = self.rank(ids[same], ids[same + 1])
        done_ids, done_owner = [], []
        while ids.size:
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.r_[first, ids.size])
            spread = np.repeat(best, sizes)
            ready = spread == NONE
            done_ids.append(ids[ready])  # words without a pair to merge leave the rounds
            done_owner.append(owner[ready])
            hit = (rank == spread) & ~ready
            # in a run of equal pairs (a a a) every second one merges, from the left
            index = np.flatnonzero(hit)
            run = np.r_[True, np.diff(index) != 1][: index.size]
            begin = np.maximum.accumulate(np.where(run, np.arange(index.size), 0))
            index = index[(np.arange(index.size) - begin) % 2 == 0]
            ids[index] = self.merged[rank[index]]
            stale = np.zeros(ids.size, dtype=bool)
            stale[index] = True
            stale[np.maximum(index - 1, 0)] = True
            keep = ~ready
            keep[index + 1] = False
            # a pair whose right half was the left half of a merge is looked up anew, as is the one before it
            before = np.flatnonzero(keep)
            ids, owner, rank, stale = ids[before], owner[before], rank[before], stale[before]
            stale[:-1] |= np.diff(before) > 1
            at = np.flatnonzero(stale)
            rank[at] = NONE
            at = at[at + 1 < ids.size]
            at = at[owner[at] == owner[at + 1]]
            rank[at] = self.rank(ids[at], ids[at + 1])
            left = np.flatnonzero(stale[1:]) if ids.size else np.empty(0, dtype=np.int64)
            left = left[owner[left] == owner[left + 1]]
            rank[left] = self.rank(ids[left], ids[left + 1])
        if not done_ids:
            return np.empty(0, dtype=np.int64), lengths
        all_ids, all_owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(all_owner, kind="stable")
        return all_ids[order], np.bincount(all_owner, minlength=lengths.size)

    def forget(self) -> None:
        """Empty the table of words; special tokens stay."""
        self.known: dict[str, int] = {s: k for k, s in enumerate(self.special)}
        self.store = np.zeros(1 << 16, dtype=np.int32)
        self.store[: len(self.special)] = list(self.special.values())
        self.used = len(self.special)
        self.begin = np.arange(self.used, dtype=np.int64)
        self.count = np.ones(self.used, dtype=np.int64)

    def learn(self, words: list[str]) -> None:
        """Encode new words together and add them to the table."""
        ids, counts = self.merge([w.encode() for w in words])
        self.known.update(zip(words, range(self.count.size, self.count.size + len(words))))
        if self.used + ids.size > self.store.size:
            grown = np.zeros(2 * (self.used + ids.size), dtype=np.int32)
            grown[: self.used] = self.store[: self.used]
            self.store = grown
        self.store[self.used : self.used + ids.size] = ids
        self.begin = np.concatenate([self.begin, self.used + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.used += ids.size

    def split(self, text: str) -> list[str]:
        """Words of a text; special tokens stand alone."""
        words = self.words if _OTHER.search(text) else _LATIN
        if not any(s in text for s in self.special):
            return words.findall(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += words.findall(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + words.findall(text[at:])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one flat array, and each text's number of ids."""
        words: list[str] = []
        sizes = np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            own = self.split(text)
            sizes[k] = len(own)
            words += own
        missing = [w for w in set(words) if w not in self.known]
        if missing and len(self.known) + len(missing) > CACHE_WORDS:
            self.forget()
            missing = [w for w in set(words) if w not in self.known]
        for k in range(0, len(missing), FLUSH_WORDS):
            self.learn(missing[k : k + FLUSH_WORDS])
        rows = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        counts = self.count[rows]
        ends = np.r_[0, np.cumsum(counts)]
        return gather(self.store, self.begin[rows], counts), np.diff(ends[np.r_[0, np.cumsum(sizes)]])

    def pieces_of(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[bytes]:
        """The bytes of each text, given all their ids and each text's number of ids."""
        yield from _joined(self.piece_bytes, self.piece_begin, self.piece_size, ids, counts)

    def decimals_of(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[bytes]:
        """Each text's ids as decimals with a comma after each."""
        yield from _joined(self.decimal_bytes, self.decimal_begin, self.decimal_size, ids, counts)

    def decode(self, ids: list[int]) -> str:
        """Text of ids: their bytes, invalid sequences replaced by U+FFFD; ids outside the vocabulary add nothing."""
        return b"".join([self.pieces.get(i, b"") for i in ids]).decode("utf-8", "replace")


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _codec(shared) -> Codec:
    """The codec of this worker; the vocabulary is parsed once per worker and file."""
    key = hashlib.sha256(shared.value).digest()
    if _CODECS.get("key") != key:
        _CODECS.update(key=key, codec=Codec(shared.value))
    return _CODECS["codec"]


_CODECS: dict = {}


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the array of token ids of ``text_col`` as ``out`` (replacing a column of that name).

    With ``decoded``, the ids are decoded again in the same pass, and the SHA-256 of that text (hex) is
    added under this name. A null text counts as empty and gives an empty array. No special tokens are
    added; a special token's string within a text becomes its id. Rows, repeated
    rows and all other columns are kept; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    made = [out] if decoded is None else [out, decoded]
    names = [c for c in docs.columns if c not in made]
    base = docs.select(*[f"`{n}`" for n in names])
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            lo = 0
            for own in groups(texts):
                ids, counts = codec.encode(own)
                columns = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids))]
                if decoded is not None:
                    columns.append(pa.array([decoded_digest(b) for b in codec.pieces_of(ids, counts)], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, counts.size).columns, *columns], [*names, *made])
                lo += counts.size

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return map_batches(base, run, f"{fields}, `{out}` array<int>" + ("" if decoded is None else f", `{decoded}` string"))


def decoded_digest(pieces: bytes) -> str:
    """SHA-256 of the text that the joined bytes of token ids are."""
    return hashlib.sha256(pieces.decode("utf-8", "replace").encode()).hexdigest()


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """Add the text of the token ids in ``ids_col`` as ``out``; a null array gives null, an empty one ''."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    names = [c for c in df.columns if c != out]
    base = df.select(*[f"`{n}`" for n in names])
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            texts = [None if ids is None else codec.decode(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return map_batches(base, run, f"{fields}, `{out}` string")


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, number of ids, and SHA-256 of the ids (decimals, comma-joined) and of the decoded text.

    Decoding joins the vocabulary's bytes of the ids and reads them as one text. Null texts count as empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        sha = hashlib.sha256
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes, numbers, decoded = [], [], []
            for own in groups(texts):
                ids, counts = codec.encode(own)
                sizes += counts.tolist()
                numbers += [sha(b[:-1]).hexdigest() for b in codec.decimals_of(ids, counts)]
                decoded += [decoded_digest(b) for b in codec.pieces_of(ids, counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(numbers, pa.string()), pa.array(decoded, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs.select(f"`{id_col}`", f"`{text_col}`"), run, schema)
