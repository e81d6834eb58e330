"""Byte-level BPE encoding and decoding (operator 1).

A batch of texts is cut into pre-tokens by `pretokenize.boundaries`; each distinct slice is looked up
in a bounded cache, and the slices not yet in it are merged together, one vectorised merge step for
all of them at a time. Byte offsets of the tokens are kept; decoding writes each token's bytes there.

Defined results: a null or empty text has no tokens, empty ids and empty bytes; a very long text makes a batch
of its own and is encoded whole; repeated rows and ties don't interact; only the columns asked for are kept,
so extra columns never clash; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackscan.llm import textvec as tv
from trackscan.llm.common import strings
from trackscan.llm.pretokenize import boundaries

#: Distinct slices that a worker remembers; beyond it the cache starts anew.
CACHE = 500_000
#: Slices of more bytes are merged one by one with a heap.
LONG = 64
NONE = np.int32(2**31 - 1)


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a .json vocabulary, and its byte."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes by id, and what each mergeable pair of tokens becomes.

    A .tiktoken file ranks tokens: any two tokens that make a ranked one merge, the least rank first,
    and a ranked slice is taken whole. A .json file lists its merges: just those pairs merge, in the
    order of the list. In both a merged token's id rises with its rank, so the id is the rank.
    """

    def __init__(self, path: str):
        self.added: dict[str, int] = {}
        if path.endswith(".json"):
            self._read_merges(path)
        else:
            self._read_ranks(path)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self._index()

    def _read_ranks(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.whole = ranks
        self._name(ranks)
        self.pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank

    def _read_merges(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, added = whole["model"], whole.get("added_tokens") or []
        if any(a.get(x) for a in added for x in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens must be plain literals")
        self.added = {a["content"]: a["id"] for a in added}
        names, ids = _byte_names(), model["vocab"]
        self._name({bytes(names[c] for c in token): i for token, i in ids.items() if all(c in names for c in token)} | {a.encode(): i for a, i in self.added.items()})
        self.whole = {}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        became = [ids[a + b] for a, b in merges]
        if any(x >= y for x, y in zip(became, became[1:])):
            raise ValueError("merged ids must rise with the order of the merges")
        self.pairs = {ids[a] << 32 | ids[b]: i for (a, b), i in zip(merges, became)}

    def _name(self, ids: dict[bytes, int]) -> None:
        self.tokens = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.tokens[i] = token
        self.single = np.array([ids.get(bytes([b]), -1) for b in range(256)], np.int32)

    def _index(self) -> None:
        """Pairs in an open-addressed table, so that whole arrays are looked up at once."""
        self.bits = max(4, (4 * len(self.pairs)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        keys, values = np.fromiter(self.pairs, np.int64, len(self.pairs)), np.fromiter(self.pairs.values(), np.int32, len(self.pairs))
        slot, self.probes = self._slot(keys), 0
        while len(keys):
            self.probes += 1
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]  # of several for one slot the last stays
            done = self.keys[slot] == keys
            self.values[slot[done]] = values[done]
            keys, values, slot = keys[~done], values[~done], (slot[~done] + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(tv.BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each merged pair; NONE where the pair doesn't merge or an end is missing (-1)."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys = np.where((left < 0) | (right < 0), -2, keys)
        slot = self._slot(keys)
        out = np.full(keys.shape, NONE, np.int32)
        todo = np.arange(keys.size)
        flat, found, at = keys.reshape(-1), out.reshape(-1), slot.reshape(-1)
        for _ in range(self.probes):
            there = self.keys[at[todo]]
            hit = there == flat[todo]
            found[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (there != -1)]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each word)."""
        counts = np.zeros(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        sizes = np.array([len(w) for w in words], np.int64)
        low = 0
        for high in (4, 8, 12, 16, 24, 32, LONG):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            for i in range(0, len(rows), 50_000):
                part = rows[i : i + 50_000]
                parts.append((part, self._merge_rows([words[r] for r in part], high)))
            low = high
        out: list[np.ndarray | None] = [None] * len(words)
        for rows, ids in parts:
            n = (ids >= 0).sum(axis=1)
            counts[rows] = n
            for r, line, k in zip(rows.tolist(), ids, n.tolist()):
                out[r] = line[:k]
        for r in np.flatnonzero(sizes > LONG).tolist():
            out[r] = self._merge_long(words[r])
            counts[r] = len(out[r])
        kept = [x for x in out if x is not None]
        return (np.concatenate(kept) if kept else np.zeros(0, np.int32)), counts

    def _merge_rows(self, words: list[bytes], width: int) -> np.ndarray:
        """Ids of words of at most `width` bytes, -1 after the last."""
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        size = np.array([len(w) for w in words])
        ids = np.where(np.arange(width) < size[:, None], self.single[raw], -1).astype(np.int32)
        whole = np.array([self.whole.get(w, -1) for w in words], np.int32) if self.whole else np.full(len(words), -1, np.int32)
        out = np.full_like(ids, -1)
        out[:, 0] = whole
        live = np.flatnonzero(whole < 0)
        now = ids[live]
        ranks = self.rank(now[:, :-1], now[:, 1:]) if width > 1 else np.full((len(now), 1), NONE)
        column = np.arange(width)
        while len(live):
            at = ranks.argmin(axis=1)
            every = np.arange(len(live))
            best = ranks[every, at]
            over = best == NONE
            if over.any():
                out[live[over]] = now[over]
                keep = ~over
                live, now, ranks, at, best = live[keep], now[keep], ranks[keep], at[keep], best[keep]
                every = np.arange(len(live))
                if not len(live):
                    break
            now[every, at] = best
            source = np.minimum(column + (column > at[:, None]), width - 1)
            now = np.take_along_axis(now, source, 1)
            now[:, -1] = -1
            short = column[:-1]
            ranks = np.take_along_axis(ranks, np.minimum(short + (short > at[:, None]), width - 2), 1)
            ranks[:, -1] = NONE
            ranks[every, at] = self.rank(now[every, at], np.where(at + 1 < width, now[every, np.minimum(at + 1, width - 1)], -1))
            before = np.maximum(at - 1, 0)
            ranks[every, before] = np.where(at > 0, self.rank(now[every, before], now[every, at]), ranks[every, before])
        return out

    def _merge_long(self, word: bytes) -> np.ndarray:
        if word in self.whole:
            return np.array([self.whole[word]], np.int32)
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        heap = [(r, i) for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or pairs.get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := pairs.get(rank << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := pairs.get(ids[h] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, h))
        return np.array([x for x in ids if x >= 0], np.int32)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Index(dict):
    """Numbers slices as they are first asked for, and lists the new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Cached:
    """Ids of pre-tokens from a bounded cache; `solve` gives those of slices not in it."""

    def __init__(self, solve: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = CACHE):
        self.solve, self.limit = solve, limit
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.counts = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _add(self, words: list[str]) -> None:
        ids, counts = self.solve(words)
        first, need = len(self.index) - len(words), len(self.index)
        while need > len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[first:need] = self.used + np.cumsum(counts) - counts
        self.counts[first:need] = counts
        self.used += len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        points, bounds = tv.points(texts)
        starts = boundaries(points, bounds)
        whole = "".join(texts)
        cuts = starts.tolist()
        words = [whole[a:b] for a, b in zip(cuts, [*cuts[1:], len(whole)])]
        if len(self.index) > self.limit:
            self._clear()
        codes = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.new:
            new, self.index.new = self.index.new, []
            self._add(new)
        counts = self.counts[codes]
        ids = take_ranges(self.flat, self.starts[codes], counts)
        upto = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(upto[np.searchsorted(starts, bounds)])


class Added:
    """Ids as the tokenizer gives them when loaded: its added tokens are taken whole before pre-tokens are cut."""

    def __init__(self, own: Cached, added: dict[str, int]):
        self.own, self.added = own, added
        self.pattern = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        if not any(a in t for a in self.added for t in texts):
            return self.own.encode(texts)
        parts, owner, after = [], [], []
        for i, text in enumerate(texts):
            cut = self.pattern.split(text)
            parts += cut[::2]
            owner += [i] * len(cut[::2])
            after += [*(self.added[a] for a in cut[1::2]), -1]
        ids, counts = self.own.encode(parts)
        special = np.array(after, np.int32)
        ends, met = np.cumsum(counts), special >= 0
        return np.insert(ids, ends[met], special[met]), np.bincount(owner, counts + met, len(texts)).astype(np.int64)


def take_ranges(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[start : start + count] of every range, one after another."""
    total = int(counts.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(counts)
    return values[np.repeat(starts - (ends - counts), counts) + np.arange(total)]


@lru_cache(2)
def encoder(path: str) -> Cached:
    vocab = vocabulary(path)
    return Cached(lambda words: vocab.merge([w.encode() for w in words]))


def _pieces(column: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column with counts[i] values of `column` in row i."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * column.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(column))]).cast(pa.binary())


def encode_batches(batches: Iterator[pa.RecordBatch], vocab_path: str) -> Iterator[pa.RecordBatch]:
    """(key, n_tokens, ids, offsets) batches of (key, text) batches."""
    own, vocab = encoder(vocab_path), vocabulary(vocab_path)
    for batch in batches:
        texts = strings(batch.column(1))
        for a, b in tv.slices(texts):
            ids, counts = own.encode(texts[a:b])
            lengths = vocab.lengths[ids]
            upto = np.cumsum(lengths) - lengths
            heads = np.cumsum(counts) - counts
            base = np.zeros(len(counts), np.int64)
            full = counts > 0
            base[full] = upto[heads[full]]
            offsets = upto - np.repeat(base, counts)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts), _pieces(ids.astype("<u4"), counts), _pieces(offsets.astype("<u4"), counts)], ["key", "n_tokens", "ids", "offsets"])


def decode_batches(batches: Iterator[pa.RecordBatch], vocab_path: str) -> Iterator[pa.RecordBatch]:
    """Batches with `decoded` after their columns: the bytes of `ids`, each token's at its offset."""
    vocab = vocabulary(vocab_path)
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            ids, offsets = ([np.frombuffer(x or b"", "<u4") for x in part.column(c).to_pylist()] for c in ("ids", "offsets"))
            counts = np.array([len(x) for x in ids], np.int64)
            ids, offsets = np.concatenate(ids).astype(np.int64), np.concatenate(offsets).astype(np.int64)
            lengths = vocab.lengths[ids]
            size = np.zeros(len(counts), np.int64)
            full = counts > 0
            size[full] = (offsets + lengths)[np.cumsum(counts)[full] - 1]
            at = np.repeat(np.cumsum(size) - size, counts) + offsets
            buffer = np.zeros(int(size.sum()), np.uint8)
            spread = np.repeat(at - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
            buffer[spread] = take_ranges(vocab.bytes, vocab.starts[ids], lengths)
            yield pa.RecordBatch.from_arrays([*part.columns, _pieces(buffer, size)], [*part.schema.names, "decoded"])


def _source(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows, f"key {rows.schema['key'].dataType.simpleString()}, n_tokens bigint, ids binary, offsets binary"


def encode(docs: DataFrame, vocab_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids and offsets of each row: two binaries of little-endian unsigned 32-bit
    numbers, the ids and the byte of the text's UTF-8 form at which each token begins."""
    rows, schema = _source(docs, key, text)
    return rows.mapInArrow(lambda batches: encode_batches(batches, vocab_path), schema).withColumnRenamed("key", key)


def decode(tokens: DataFrame, vocab_path: str) -> DataFrame:
    """tokens (ids and offsets, and any other columns but `decoded`) with `decoded`, the bytes."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(lambda batches: decode_batches(batches, vocab_path), f"{schema}, decoded binary")


def round_trip(docs: DataFrame, vocab_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What `decode` makes of `encode`, in one pass of one worker."""
    rows, schema = _source(docs, key, text)
    done = rows.mapInArrow(lambda batches: decode_batches(encode_batches(batches, vocab_path), vocab_path), f"{schema}, decoded binary")
    return done.withColumnRenamed("key", key)


def query(docs: DataFrame, vocab_path: str) -> DataFrame:
    """Digests of what encoding every text, and decoding the ids again, gives."""
    done = round_trip(docs, vocab_path)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
