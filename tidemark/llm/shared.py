"""Which hashes occur in several documents, found by an exchange of packed blocks.

Documents are dealt into groups by a hash of their id. A group sends the distinct hashes of its documents to
buckets, packed as arrays, with the number of its documents that have each; a bucket adds up what it gets and
answers every group with those of its hashes that two documents or more have. So a hash that a third of all
documents share costs one entry per group, not one per document, and no task holds more than a bucket or a group.
The exchange of documents by group is the same wherever it is used in a plan, so Spark runs it once.

Words are told apart by 64-bit hashes of their bytes, and runs of words by hashes of these. A hash travels as its bucket and 32 bits. Two that fall together look shared, which costs work further
on but changes no result: whoever asks verifies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import MAX_ID, input_partitions, shuffle_partitions, trim

GROUPS_PER_PARTITION, BUCKETS_PER_PARTITION, AT_ONCE, LONG_WORD = 8, 2, 1 << 16, 512
#: A group's count of a key goes no further; the sum of such counts is as great as can be.
MANY = 255
LOW = np.uint64((1 << 32) - 1)
_ONE = 0xD1342543DE82EF95  # odd: a base of polynomials modulo 2**64, with an inverse
_BASES = (np.uint64(0x9E3779B97F4A7C17), np.uint64(0xC2B2AE3D27D4EB4B))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, up to n at least."""
    for k, base in enumerate((_ONE, pow(_ONE, -1, 1 << 64))):
        while len(_powers[k]) <= n:
            _powers[k] = np.concatenate([_powers[k], _powers[k] * np.uint64(pow(base, len(_powers[k]), 1 << 64))])
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of texts that stand one after another in ``data``."""

    hashes: np.ndarray
    ends: np.ndarray  # words: where each text begins and the last ends
    start: np.ndarray  # bytes, of every word
    stop: np.ndarray
    data: np.ndarray
    edges: np.ndarray  # bytes: where each text begins and the last ends

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the lines that have words: where each begins among the words and the last ends, its text, its place in it."""
        breaks = np.flatnonzero(self.data == 10)
        first = np.unique(np.concatenate([self.ends[:-1], np.searchsorted(self.start, breaks)]))
        first = first[first < len(self.start)]
        text = np.searchsorted(self.ends, first, side="right") - 1
        line = np.searchsorted(breaks, self.start[first]) - np.searchsorted(breaks, self.edges[text])
        return np.append(first, len(self.start)), text, line


def words_of(column: pa.ChunkedArray, lower=False) -> Words:
    """All in array operations: a word's hash is that of its bytes, read off prefix sums of a polynomial. Words of more than LONG_WORD
    bytes are hashed one by one: there are long words that no polynomial modulo a power of two tells apart."""
    texts = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        none = np.empty(0, np.int64)
        return Words(np.empty(0, np.uint64), np.zeros(1, np.int64), none, none, np.empty(0, np.uint8), np.zeros(1, np.int64))
    edges = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    # plain arithmetic on bytes is several times as fast as looking them up
    data = data + ((data - np.uint8(65)) < 26).view(np.uint8) * np.uint8(32) if lower else data
    word = ((data - np.uint8(9)) > 4) & (data != 32)
    turns = np.flatnonzero(word[1:] != word[:-1]) + 1
    inner = edges[(edges > 0) & (edges < len(data))]
    inner = np.unique(inner[word[inner] & word[inner - 1]])  # a text ends in a word, the next begins with one
    ends_ = [np.zeros(int(len(word) and word[0]), np.int64), turns, inner, inner, np.full(int(len(word) and word[-1]), len(word))]
    turns = np.sort(np.concatenate(ends_)) if len(inner) else np.concatenate(ends_)
    start, stop = turns[::2], turns[1::2]
    hashes = np.empty(len(start), np.uint64)
    sums = np.zeros(AT_ONCE + 1, np.uint64)
    at = 0
    while at < len(start):
        low = start[at]
        to = max(at + 1, int(np.searchsorted(stop, low + AT_ONCE, side="right")))
        piece = data[low : stop[to - 1]]
        if len(piece) >= len(sums):
            sums = np.zeros(len(piece) + 1, np.uint64)
        power, inverse = _power_tables(len(piece))
        terms = piece.astype(np.uint64)
        terms += np.uint64(1)
        terms *= power[: len(piece)]
        np.cumsum(terms, out=sums[1 : len(piece) + 1])
        own = start[at:to] - low
        hashes[at:to] = (sums[stop[at:to] - low] - sums[own]) * inverse[own]
        at = to
    hashes = mixed(hashes)
    for k in np.flatnonzero(stop - start > LONG_WORD).tolist():
        hashes[k] = int.from_bytes(hashlib.blake2b(data[start[k] : stop[k]].tobytes(), digest_size=8).digest(), "little")
    return Words(hashes, np.searchsorted(start, edges), start, stop, data, edges)


def rolling(h: np.ndarray, width: int, base=0) -> np.ndarray:
    """Hash of the run of ``width`` words that starts at each place, as far as there are so many; mixed."""
    n = max(0, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= _BASES[base]
        out += h[k : k + n]
    return mixed(out)


def _packed_keys(key: np.ndarray) -> bytes:
    """Rising 32-bit numbers as differences, byte plane by byte plane: the upper planes are nearly constant."""
    d = np.diff(key.astype(np.uint32), prepend=np.uint32(0)).astype("<u4")
    return d.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked_keys(data: bytes) -> np.ndarray:
    d = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(d, dtype=np.uint32).astype(np.uint64)


def planes(n: np.ndarray) -> bytes:
    return n.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Plan:
    """Documents as (g, doc_id, text, rest), and how many groups and buckets there are."""

    def __init__(self, docs: DataFrame, id_col="doc_id", text_col="text", others: list[str] | None = None):
        parts = input_partitions(docs)
        self.groups, self.buckets = GROUPS_PER_PARTITION * parts, max(shuffle_partitions(docs.sparkSession), BUCKETS_PER_PARTITION * parts)
        key = F.coalesce(F.col(id_col).cast("long"), F.lit(MAX_ID))
        rest = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest")] if others else []
        self.docs = docs.select(F.pmod(F.xxhash64(key), F.lit(self.groups)).alias("g"), key.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *rest)

    def key_of(self) -> Callable[[np.ndarray], np.ndarray]:
        """From hashes to keys: the bucket in the upper half, 32 more bits in the lower."""
        buckets = np.uint64(self.buckets)
        return lambda h: (h >> np.uint64(32)) % buckets << np.uint64(32) | h & LOW

    def asked(self, keys: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        """(bucket, g, low, n): keys gets the documents of a group and returns rising keys and their counts."""
        schema = pa.schema([("bucket", pa.int32()), ("g", pa.int64()), ("low", pa.binary()), ("n", pa.binary())])

        def ask(docs: pa.Table) -> pa.Table:
            key, n = keys(docs)
            n = np.minimum(n, MANY).astype(np.uint8)
            bucket = key >> np.uint64(32)
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
            pairs = list(zip(starts.tolist(), [*starts.tolist()[1:], len(key)], strict=True)) if len(key) else []
            columns = [bucket[starts].astype(np.int32), np.full(len(starts), docs.column("g")[0].as_py()), [_packed_keys(key[a:b]) for a, b in pairs], [n[a:b].tobytes() for a, b in pairs]]
            return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        return self.docs.groupBy("g").applyInArrow(_lean(ask), "bucket int, g long, low binary, n binary")

    def shared(self, keys: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        """(g, bucket, low, n): per group and bucket, the keys that two documents or more have, rising, and how many
        (2**32 - 1 if a group alone has MANY)."""
        schema = pa.schema([("g", pa.int64()), ("bucket", pa.int32()), ("low", pa.binary()), ("n", pa.binary())])

        def answer(asked: pa.Table) -> pa.Table:
            groups = asked.column("g").to_numpy()
            lows = [_unpacked_keys(x) for x in asked.column("low").to_pylist()]
            low = np.concatenate(lows).astype(np.uint32)
            n = np.concatenate([np.frombuffer(x, np.uint8) for x in asked.column("n").to_pylist()])
            of = np.repeat(np.arange(len(lows), dtype=np.uint32), [len(x) for x in lows])
            order = np.argsort(low)
            sorted_low = low[order]
            starts = np.flatnonzero(np.append(True, sorted_low[1:] != sorted_low[:-1]))
            total = np.add.reduceat(np.where(n[order] == MANY, 1 << 32, n[order].astype(np.int64)), starts)
            total = np.repeat(total, np.diff(np.append(starts, len(low))))
            back = np.zeros(len(low), np.uint32)
            back[order] = np.minimum(total, 2**32 - 1)
            keep = back > 1  # in the order of the groups, and rising in each
            low, of, back = low[keep], of[keep], back[keep]
            starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
            pairs = list(zip(starts.tolist(), [*starts.tolist()[1:], len(of)], strict=True)) if len(of) else []
            columns = [groups[of[starts]], np.full(len(starts), asked.column("bucket")[0].as_py()), [_packed_keys(low[a:b]) for a, b in pairs], [planes(back[a:b]) for a, b in pairs]]
            return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        return self.asked(keys).groupBy("bucket").applyInArrow(_lean(answer), "g long, bucket int, low binary, n binary")

    def counter(self) -> Callable[[pa.Table], Callable[[np.ndarray], np.ndarray]]:
        """Of a group's answers: a function from hashes to their numbers of documents, 1 if not shared."""
        key_of = self.key_of()

        def of_answers(answers: pa.Table) -> Callable[[np.ndarray], np.ndarray]:
            rows = sorted(zip(*(answers.column(c).to_pylist() for c in ("bucket", "low", "n")), strict=True))
            keys = np.concatenate([*(_unpacked_keys(low) | np.uint64(b) << np.uint64(32) for b, low, _ in rows), np.array([2**64 - 1], np.uint64)])
            counts = np.concatenate([*(unplaned(n) for *_, n in rows), np.ones(1, np.uint32)])

            def look_up(h: np.ndarray) -> np.ndarray:
                k = key_of(h)
                order = np.argsort(k)  # searching in order is several times as fast
                at = np.empty(len(k), np.int64)
                at[order] = np.searchsorted(keys, k[order])
                return np.where(keys[at] == k, counts[at], 1)

            return look_up

        return of_answers

    def with_answers(self, answers: DataFrame, made: Callable[[pa.Table, pa.Table], pa.Table], schema) -> DataFrame:
        """made gets the documents of a group and what was answered to it."""

        def run(docs: pa.Table, found: pa.Table) -> pa.Table:
            out = made(docs, found)
            trim()
            return out

        return self.docs.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(run, schema)


def _lean(made: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        out = made(rows)
        trim()
        return out

    return run


def pack40(low: np.ndarray) -> bytes:
    return low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack40(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(np.uint64)
