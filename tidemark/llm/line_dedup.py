"""Line dedup: an exact set-similarity join of lines, by which later matches of a line are removed.

A line's tokens are its word shingles (of fewer words, the whole line). The join is that of ``jaccard_join`` with lines for
units: tokens in the order of their rarity, a prefix of them indexed, pairs that sizes or places rule out
passed over, the rest decided exactly. Lines of equal token sets are one class, which stands where it first does.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import durable, release, remove, table, unused, written
from tidemark.llm.jaccard_join import ALIKE, HEAD, HEADS, SHINGLE, class_links, heads_of, may_share, occurrences, shingle_sets, signatures, subset
from tidemark.llm.shared import Plan, mixed, words_of


def later_matches(plan: Plan, width=SHINGLE, alike=ALIKE, min_words=1) -> DataFrame:
    """(g, doc_id, row, line): the lines of ``min_words`` words or more of which an earlier one, by doc_id and place, is alike
    enough: 100 I >= 75 U of the token sets. row tells rows of equal doc_id apart, by their texts."""
    counter, key_of = plan.counter(), plan.key_of()

    def lines_of(docs: pa.Table):
        w = words_of(docs.column("text"), lower=True)
        ends, text, line = w.lines()
        keep = np.diff(ends) >= min_words
        if not keep.all():
            w.hashes, text, line = w.hashes[np.repeat(keep, np.diff(ends))], text[keep], line[keep]
            ends = np.append(0, np.cumsum(np.diff(ends)[keep]))
        return w, ends, text, line

    def keys(docs: pa.Table):
        w, ends, *_ = lines_of(docs)
        return occurrences(w, ends, key_of, width)

    def sign(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(docs):
            return HEADS.empty_table()
        docs, rows = ordered(docs)
        w, ends, text, line = lines_of(docs)
        if not len(text):
            return HEADS.empty_table()
        look_up = counter(answers)
        # a line that is too much alone has a token that no other has, so it has no copy either and is left out
        which, short = may_share(w, ends, look_up, width, alike), np.diff(ends) < width
        if short.any():
            which[short] = look_up(shingle_sets(*subset(w.hashes, ends, short), width).hashes) > 1
        if not which.any():
            return HEADS.empty_table()
        h, ends = subset(w.hashes, ends, which)
        text, line, n_words = text[which], line[which], np.diff(ends)
        # lines are told apart by their words in order: others of equal sets are found alike
        place = np.arange(len(h), dtype=np.uint64) - np.repeat(ends[:-1], n_words).astype(np.uint64)
        digest = np.stack([np.add.reduceat(mixed(h + (place + np.uint64(1)) * np.uint64(odd)), ends[:-1]) for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)], 1)
        own, columns = heads_of(docs.column("g")[0].as_py(), digest, docs.column("doc_id").to_numpy()[text], (rows[text].astype(np.int64) << 32) + line)
        head = np.zeros(len(text), bool)
        head[own] = True
        sets = shingle_sets(*subset(h, ends, head), width)
        signed = dict(zip(np.flatnonzero(head).tolist(), signatures(sets, look_up(sets.hashes), alike), strict=True))
        signed = [signed[i] for i in own.tolist()]
        columns += [[x[0] for x in signed], [x.tobytes() for x in digest[own]], [x[2] for x in signed], [x[3] for x in signed]]
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, HEADS, strict=True)], schema=HEADS)

    heads = written(plan.with_answers(plan.shared(keys), sign, HEAD))
    classes, gone, _ = class_links(heads, alike, first=True)
    # a class is looked up if it has several lines or goes as a whole
    some = classes.where("size > 1").select("digest", F.col("p1").alias("first1"), F.col("p2").alias("first2"), F.lit(False).alias("gone"))
    none = F.lit(None).cast("long")
    some = some.unionByName(gone.select("digest", none.alias("first1"), none.alias("first2"), F.lit(True).alias("gone")))
    some = some.groupBy("digest").agg(F.max("first1").alias("first1"), F.max("first2").alias("first2"), F.max("gone").alias("gone"))
    found = heads.select("g", "digest", F.arrays_zip("members1", "members2").alias("at")).join(some, "digest")
    found = found.select("g", "first1", "first2", "gone", F.explode("at").alias("at")).where("gone or at.members1 != first1 or at.members2 != first2")
    found = durable(found.select("g", F.col("at.members1").alias("doc_id"), F.shiftright("at.members2", 32).cast("int").alias("row"), F.col("at.members2").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("line")))
    remove(heads)
    del heads, classes, gone, some
    release(found.sparkSession)
    return found


def ordered(docs: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The documents of a group in the order of (doc_id, text), and each one's place among those of its doc_id."""
    docs = docs.take(pa.compute.sort_indices(docs.select(["doc_id", "text"]), [("doc_id", "ascending"), ("text", "ascending")]))
    ids = docs.column("doc_id").to_numpy()
    new = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    return docs, (np.arange(len(ids)) - np.repeat(new, np.diff(np.append(new, len(ids))))).astype(np.int32)


def dedup_lines(docs: DataFrame, width=SHINGLE, alike=ALIKE, min_words=1, id_col="doc_id", text_col="text", lines_col="_lines") -> DataFrame:
    """The documents, all columns kept, their texts without the lines that match an earlier one, and as ``n_lines`` and
    ``n_removed`` in a struct ``lines_col`` the numbers of lines with words before and of those removed; the struct is the last column and gets
    underscores before its name while another column is called so. ``width`` is the number of words of a token: 1 compares the sets of words themselves.

    Lines without words stay. A null text stays null; a null doc_id comes last; rows that repeat a doc_id follow one another by
    their texts. Ids are integers. An empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructType

    lines_col = unused(docs, lines_col)
    own, none_col = docs.columns, unused(docs, "_none")
    out = docs.schema
    docs = docs.withColumn(none_col, F.col(f"`{text_col}`").isNull())
    plan = Plan(docs, id_col, text_col, [*(c for c in own if c != text_col), none_col])
    out = StructType([*out.fields]).add(lines_col, StructType().add("n_lines", LongType()).add("n_removed", LongType()))
    arrow = to_arrow_schema(out)
    at = own.index(text_col)

    def cut(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not len(docs):
            return arrow.empty_table()
        docs, rows = ordered(docs)
        gone: dict[tuple[int, int], set[int]] = {}
        for doc_id, row, line in zip(*(found.column(c).to_pylist() for c in ("doc_id", "row", "line")), strict=True):
            gone.setdefault((doc_id, row), set()).add(line)
        rest = docs.column("rest").combine_chunks()
        texts, counts = [], []
        for doc_id, row, text, none in zip(docs.column("doc_id").to_pylist(), rows.tolist(), docs.column("text").to_pylist(), rest.field(len(own) - 1).to_pylist(), strict=True):
            lines, out_ = text.split("\n"), gone.get((doc_id, row), ())
            counts.append({"n_lines": sum(1 for x in lines if x.strip(" \t\n\x0b\f\r")), "n_removed": len(out_)})
            texts.append(None if none else "\n".join(x for k, x in enumerate(lines) if k not in out_) if out_ else text)
        others = iter(range(len(own) - 1))
        columns = [pa.array(texts, pa.string()) if k == at else rest.field(next(others)) for k in range(len(own))]
        return pa.table([*(c.cast(f.type) for c, f in zip(columns, arrow, strict=False)), pa.array(counts, arrow[-1].type)], schema=arrow)

    return plan.with_answers(later_matches(plan, width, alike, min_words), cut, out)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "_lines.n_lines", "_lines.n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
