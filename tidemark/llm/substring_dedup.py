"""Substring dedup over words, by anchors at the places of a difference cover.

COVER holds, for any difference modulo PERIOD, two members that differ by it. So for a window that starts at i in
one document and at j in another, some k < PERIOD puts both i + k and j + k on the cover: the two share the
anchor of ``width - PERIOD + 1`` words there. Anchors are hashed at cover places only, 3 of 7, and a window can occur
elsewhere only if one of its anchors does. Such windows are extended to their full width and hashed twice, with 40 bits of each hash besides
the bucket, and the least doc_id that has each is found; a word goes if a window over it occurs in an earlier document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import MAX_ID, table
from tidemark.llm.shared import Plan, pack40, rolling, unpack40, words_of

LOW = np.uint64((1 << 40) - 1)
#: A perfect difference set.
PERIOD, COVER = 7, (1, 2, 4)
_ON_COVER = np.isin(np.arange(PERIOD), COVER)


def _anchors(ends: np.ndarray, total: int, size: int, width: int) -> np.ndarray:
    """Places of the anchors that lie in some window of their document."""
    n = np.diff(ends)
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(total) - ends[:-1][of]
    return np.flatnonzero(_ON_COVER[place % PERIOD] & (place + size <= n[of]) & (n[of] >= width))


def remove_repeats(docs: DataFrame, width=13, with_text=False, id_col="doc_id", text_col="text") -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (and kept_text): the text without the words that a window of
    ``width`` words covers whose words also stand in a document of smaller doc_id. Windows are judged on the input.

    A null text has no words; a null doc_id counts as greater than all; rows that repeat a doc_id, and repeats within a
    document, take nothing from one another; an empty table gives no rows.
    """
    if width < PERIOD + 1:
        raise ValueError(f"windows must have {PERIOD + 1} words at least")
    size, plan = width - PERIOD + 1, Plan(docs, id_col, text_col)
    counter, buckets, key_of = plan.counter(), plan.buckets, plan.key_of()

    def anchor_keys(docs: pa.Table):
        w = words_of(docs.column("text"))
        at = _anchors(w.ends, len(w.hashes), size, width)
        if not len(at):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        key = key_of(rolling(w.hashes, size)[at])
        order = np.argsort(key)
        key, ids = key[order], docs.column("doc_id").to_numpy()[np.searchsorted(w.ends, at, side="right")[order] - 1]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return key[starts], 1 + (np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts))

    def inside(ends: np.ndarray, total: int) -> np.ndarray:
        """Starts of the windows that don't leave their document."""
        i = np.arange(max(0, total - width + 1))
        return i[i + width <= ends[np.searchsorted(ends, i, side="right")]] if len(i) else i

    def extended(docs: pa.Table, h, ends, i):
        """Two hashes and the doc_id of the windows that start at i."""
        a, b = (rolling(h, width, base)[i] for base in (0, 1)) if len(i) else (np.empty(0, np.uint64),) * 2
        a, b = (a >> np.uint64(40)) % np.uint64(buckets) << np.uint64(40) | a & LOW, b & LOW
        return a, b, docs.column("doc_id").to_numpy()[np.searchsorted(ends, i, side="right") - 1] if len(i) else np.empty(0, np.int64)

    def least(a, b, ids):
        """Per distinct window its least id, as sorted arrays."""
        order = np.lexsort((ids, b, a))
        a, b, ids = a[order], b[order], ids[order]
        first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
        return a[first], b[first], ids[first]

    def packed(a, b, ids, part) -> tuple[list, list[list[bytes]]]:
        """Parts, and of each its hashes in the order of their ids, the ids, and how many hashes each has."""
        order = np.lexsort((ids, part))
        a, b, ids, part = pack40(a[order] & LOW), pack40(b[order]), ids[order], part[order]
        own, starts = np.unique(part, return_index=True)
        columns: list[list[bytes]] = [[], [], [], []]
        cuts = [*starts.tolist(), len(part)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            each, n = np.unique(ids[x:y], return_counts=True)
            for c, data in zip(columns, (a[5 * x : 5 * y], b[5 * x : 5 * y], each.tobytes(), n.astype(np.uint32).tobytes()), strict=True):
                c.append(data)
        return own.tolist(), columns

    def unpacked(found: pa.Table):
        """Hashes with their bucket, ids, and the row of each."""
        empty = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        parts = [empty]
        for k, (bucket, a, b, ids, n) in enumerate(zip(*(found.column(c).to_pylist() for c in ("bucket", "a", "b", "ids", "n")), strict=True)):
            a = unpack40(a) | np.uint64(bucket) << np.uint64(40)
            parts.append((a, unpack40(b), np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(n, np.uint32)), np.full(len(a), k)))
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    schema = pa.schema([("bucket", pa.int32()), ("g", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("ids", pa.binary()), ("n", pa.binary())])
    ddl = "bucket int, g long, a binary, b binary, ids binary, n binary"

    def made(buckets_, groups_, columns) -> pa.Table:
        return pa.table([pa.array(x, f.type) for x, f in zip([buckets_, groups_, *columns], schema, strict=True)], schema=schema)

    def ask(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(docs):
            return schema.empty_table()
        w = words_of(docs.column("text"))
        h, ends = w.hashes, w.ends
        at, hit = _anchors(ends, len(h), size, width), np.zeros(len(h) + PERIOD, bool)
        if len(at) and len(answers):
            hit[at] = counter(answers)(rolling(h, size)[at]) > 1
        before, i = np.append(0, np.cumsum(hit)), inside(ends, len(h))
        i = i[before[i + PERIOD] > before[i]]
        a, b, ids = least(*extended(docs, h, ends, i))
        own, columns = packed(a, b, ids, (a >> np.uint64(40)).astype(np.int64))
        return made(own, [docs.column("g")[0].as_py()] * len(own), columns)

    def answer(asked: pa.Table) -> pa.Table:
        a, b, ids, of = unpacked(asked)
        order = np.lexsort((ids, b, a))
        a, b, ids, of = a[order], b[order], ids[order], of[order]
        first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        lowest = ids[np.flatnonzero(first)][np.cumsum(first) - 1]
        news = lowest < ids  # the other groups know it already
        own, columns = packed(a[news], b[news], lowest[news], of[news])
        groups = asked.column("g").to_numpy()
        return made([asked.column("bucket")[0].as_py()] * len(own), groups[own].tolist() if own else [], columns)

    names = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    out_schema = pa.schema(names + [("kept_text", pa.string())] * with_text)

    def remove(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(docs):
            return out_schema.empty_table()
        w = words_of(docs.column("text"))
        h, ends = w.hashes, w.ends
        ta, tb, tids, _ = unpacked(answers)
        i, covered = inside(ends, len(h)), np.zeros(len(h) + 1, np.int64)
        if len(i):
            # only windows that stand twice in this group, or of which an earlier place is known, can go
            a, *_ = extended(docs, h, ends, i)
            order = np.argsort(a)
            same = a[order][1:] == a[order][:-1]
            twice = np.zeros(len(i), bool)
            twice[order] = np.append(same, False) | np.append(False, same)
            i = i[twice | np.isin(a, ta)]
        if len(i):
            a, b, ids = extended(docs, h, ends, i)
            la, lb, lids = least(np.append(a, ta), np.append(b, tb), np.append(ids, tids))
            at = np.searchsorted(la, a)
            while (other := lb[at] != b).any():  # windows of the same first hash follow one another
                at = at + other
            gone = i[lids[at] < ids]
            np.add.at(covered, gone, 1)
            np.add.at(covered, gone + width, -1)
        covered = np.cumsum(covered) > 0
        rows = []
        texts = docs.column("text").cast(pa.binary()).to_pylist()
        for k, (doc_id, text) in enumerate(zip(docs.column("doc_id").to_pylist(), texts, strict=True)):
            out, own = covered[ends[k] : ends[k + 1]], text.split()
            kept = b" ".join([x for x, c in zip(own, out.tolist(), strict=True) if not c] if out.any() else own)
            row = (None if doc_id == MAX_ID else doc_id, len(own), int(out.sum()), hashlib.sha256(kept).hexdigest())
            rows.append(row + (kept.decode(),) * with_text)
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), out_schema, strict=True)], schema=out_schema)

    asked = plan.with_answers(plan.shared(anchor_keys), ask, ddl)
    earlier = asked.groupBy("bucket").applyInArrow(answer, ddl)
    return plan.with_answers(earlier, remove, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
