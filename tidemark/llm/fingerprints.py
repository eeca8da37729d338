"""Document fingerprints from prefix polynomial hashes.

For a text with code points c[0..n) and a base b modulo a prime p, S[i] = sum over k < i of (c[k]+1) * b**k.
(S[j] - S[i]) * b**(M - i), M a common shift, then is a hash of the span [i, j) alone, so two spans of any texts are
compared in constant time, and the longest common extension of two places is a binary search. Two primes
near 2**31 make 62 bits.

A fingerprint holds the length, the hash of the whole text, and the smallest hashes of the spans of
``SPAN`` code points, read off the same prefix array; the share that two fingerprints have in common
estimates the Jaccard similarity of the sets of spans.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import MAX_ID, input_partitions, table, trim

PRIMES, BASES = (2147483647, 2147483629), (1_000_003_919, 1_315_423_911)
SPAN, KEPT = 16, 64
#: Ranges of documents for each input partition; each is a task that streams, so its memory doesn't depend on its length.
RANGES_PER_PARTITION = 2

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_table(k: int, n: int) -> np.ndarray:
    """b**0 .. b**n at least, modulo the prime; grown by doubling and kept."""
    have, p = _powers[k], np.uint64(PRIMES[k])
    while len(have) <= n:
        step = np.uint64(pow(BASES[k], len(have), PRIMES[k]))
        have = np.concatenate([have, have * step % p])
    _powers[k] = have
    return have


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class PrefixHashes:
    """Prefix arrays of a text."""

    def __init__(self, text: str):
        c = code_points(text).astype(np.uint64) + np.uint64(1)
        self.n = len(c)
        self.sums = []
        for k, p in enumerate(PRIMES):
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(c * _power_table(k, self.n)[: self.n] % np.uint64(p), out=s[1:])
            self.sums.append(s % np.uint64(p))

    def span(self, i: int, j: int, shift: int) -> tuple[int, ...]:
        """Hash of [i, j); shift >= i must be the same for spans that are compared."""
        return tuple((int(s[j]) - int(s[i])) * int(_power_table(k, shift - i)[shift - i]) % PRIMES[k] for k, s in enumerate(self.sums))

    def equal(self, i: int, other: PrefixHashes, j: int, length: int) -> bool:
        if max(i + length - self.n, j + length - other.n) > 0:
            return False
        shift = max(i, j)
        return self.span(i, i + length, shift) == other.span(j, j + length, shift)

    def common_extension(self, i: int, other: PrefixHashes, j: int) -> int:
        """Length of the longest span that starts at i here and at j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, other, j, mid) else (low, mid - 1)
        return low

    def spans(self, length: int) -> np.ndarray:
        """Hash of the span of this length at every place, modulo the first prime."""
        if self.n < length:
            return np.empty(0, np.uint64)
        p, s = np.uint64(PRIMES[0]), self.sums[0]
        m = self.n - length
        return (s[length:] + p - s[: m + 1]) % p * _power_table(0, m)[m::-1] % p * np.uint64(pow(BASES[0], MAX_SHIFT - m, PRIMES[0])) % p


#: Shift of the spans of all texts; longer texts have no meaning here (2**40 code points).
MAX_SHIFT = 1 << 40


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str) -> str:
    """length.hash.sketch in hex. An empty text has an empty sketch; one shorter than SPAN is one span."""
    hashes = PrefixHashes(text)
    whole = "".join(f"{x:08x}" for x in hashes.span(0, hashes.n, 0))
    x = hashes.spans(SPAN)
    if not len(x):
        x = np.array([int(whole, 16)] * bool(hashes.n), np.uint64)
    x = _mix(x + np.uint64(1)) >> np.uint64(32)
    few = x[x < (1 << 32) * 4 * KEPT / max(1, len(x))]
    least = np.unique(few)[:KEPT]
    if len(least) < KEPT:
        least = np.unique(x)[:KEPT]
    return f"{hashes.n:x}.{whole}." + least.astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """0 to 1 from two fingerprints: 1 for equal ones, else the share of the least hashes of both that both have."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rpartition(".")[2]), ">u4") for f in (a, b))
    least = np.union1d(x, y)[:KEPT]
    return float(np.isin(least, np.intersect1d(x, y)).mean()) if len(least) else 0.0


def edited(text: str, following: str) -> str:
    """The text, its last quarter of code points replaced by the first as many of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _ranges(bounds: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The last of the sorted bounds (id, hash) that isn't after each document."""
    low, high = (np.searchsorted(bounds[:, 0], ids, side) for side in ("left", "right"))
    out = low.copy()
    # only where an id is a bound itself do hashes decide, bound by bound of that id
    tied = np.flatnonzero(high > low)
    for a in np.unique(low[tied]):
        own = tied[low[tied] == a]
        out[own] = a + np.searchsorted(bounds[a : high[own[0]], 1], hashes[own], "right")
    return np.maximum(out - 1, 0)


def with_following(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(range, extra, doc_id, text), partitioned by range and sorted: in each range the documents of a span of
    (id, hash of the text), and as extra ones those that follow the last of them (after the very last, the first).

    Ranges are those of a sort of ids and hashes alone, as many as the input needs, so they are even for any ids, and texts of one id are
    split too. Only the first id and hash of each reach the driver and the tasks: 16 bytes a range.
    """
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(MAX_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("h", F.xxhash64("text"))
    n = RANGES_PER_PARTITION * input_partitions(docs)
    keys = d.select("doc_id", "h").repartitionByRange(n, "doc_id", "h").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("doc_id", "h")).alias("k"))
    bounds = np.array(sorted((r[0], r[1]) for r in keys.select("k.doc_id", "k.h").collect()), np.int64).reshape(-1, 2)

    @F.pandas_udf("array<int>")
    def places(ids, hashes):
        """The document's range, and, as -1 - range, the one that it is the extra of."""
        import pandas as pd

        ids, hashes = ids.to_numpy(), hashes.to_numpy()
        r = _ranges(bounds, ids, hashes)
        first = (bounds[r] == np.stack([ids, hashes], 1)).all(1)
        return pd.Series([[x, -1 - (x - 1) % len(bounds)] if f else [x] for x, f in zip(r.tolist(), first.tolist(), strict=True)], dtype=object)

    at = d.select("doc_id", "text", "h", F.explode(places("doc_id", "h")).alias("at"))
    own = at.select(F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at")).alias("range"), (F.col("at") < 0).cast("int").alias("extra"), "doc_id", "text", "h")
    return own.repartitionById(max(1, len(bounds)), "range").sortWithinPartitions("range", "extra", "doc_id", "h", "text").drop("h")


def fingerprint_documents(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id,
    next_common (code points that it and the next document share from their beginnings).

    A null text is empty; a null doc_id comes last; rows that repeat a doc_id follow one another in the order of a hash of their texts. Ids
    are integers. An empty table gives no rows.
    """
    columns = [("doc_id", "long"), ("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"),
               ("near_edited", "double"), ("near_next", "double"), ("next_id", "long"), ("next_common", "long")]
    arrow = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(n, arrow[t]) for n, t in columns])

    def measured(batches):
        last = None  # the document whose next one hasn't come yet: range, id, text, fingerprint
        for batch in batches:
            rows = []
            ranges, extras, ids = (batch.column(i).to_pylist() for i in range(3))
            for i, (r, extra, doc_id) in enumerate(zip(ranges, extras, ids, strict=True)):
                if extra and (last is None or last[0] != r):
                    continue
                text = batch.column(3)[i].as_py()
                own = fingerprint(text)
                if last is not None and last[0] == r:
                    rows.append(_row(last, doc_id, text, own))
                last = None if extra else (r, doc_id, text, own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        trim()

    return with_following(docs, id_col, text_col).mapInArrow(measured, ", ".join(f"{n} {t}" for n, t in columns))


def _row(last, next_id: int, following: str, next_print: str) -> tuple:
    _, doc_id, text, own = last
    new = edited(text, following)
    new_print = fingerprint(new)
    common = PrefixHashes(text[:4096]).common_extension(0, PrefixHashes(following[:4096]), 0) if text[:1] == following[:1] else 0
    if common == 4096:
        common = PrefixHashes(text).common_extension(0, PrefixHashes(following), 0)
    back = lambda i: None if i == MAX_ID else i
    return (back(doc_id), len(text), hashlib.sha256(new.encode()).hexdigest(), own, new_print, likeness(own, new_print), likeness(own, next_print), back(next_id), common)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
