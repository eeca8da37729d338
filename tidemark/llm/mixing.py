"""Mixing sources to target weights, by distributed prefix sums over hash-random keys. DataFrame operations only.

Every document gets a key from a hash of its id. Within a source the documents stand in the order of
their keys, dealt over equal ranges of keys ("cells"), so that no task holds a source, however large.
Sums by cell give each cell its place in the source's running total; only the one cell of a source in
which the budget ends is then summed document by document. What a source takes is thereby a cut point:
whole epochs, and in the last epoch all documents before the cut, and of the one at the cut so many words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BLANK, durable, input_partitions, table, words

#: Sources a plan may have to be sent to all tasks; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 50_000


def _key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def source_targets(totals: DataFrame, weights=(3, 1, 2), share=1.5, epochs=2) -> DataFrame:
    """(source, source_size) -> also weight and target, one row per source.

    Weights repeat over the sources in the order of code points, null last. The targets share
    ``share`` of all sizes by weight; one that would pass ``epochs`` times its source's size stops
    there, and the rest of it goes to the others by weight. With the sources in the order of
    size / weight, the full ones come first, so running sums give the common level of the others.
    """
    ranked = totals.withColumn("_at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    order = Window.orderBy("_ratio", "_at")
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        ranked.withColumn("weight", weight)
        .withColumn("_cap", (F.lit(epochs) * F.col("source_size")).cast("double"))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_all", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("_full", F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_all") - F.coalesce("_full", F.lit(0.0))) / F.col("_open"))
        .withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(whole))
    )
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("weight"), F.col("_cap")))
    return level.select("source", "source_size", "weight", target.alias("target"))


def _sized(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.size(words(F.col(text_col))).cast("long").alias("size"), _key(F.col(id_col), seed).alias("key"),
    )


def mix_plan(sized: DataFrame, cells: int, weights=(3, 1, 2), share=1.5, epochs=2) -> DataFrame:
    """One row per source: target, whole epochs, and the cut (cut_key, cut_id, cut_before, cut_words).

    Rows that repeat a doc_id within a source count as one document.
    """
    cell = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * cells / F.lit(2**32))
    keyed = sized.withColumn("cell", cell)
    sums = durable(keyed.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")))
    targets = source_targets(sums.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, share, epochs)
    plan = targets.withColumn("budget", F.floor("target")).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0)
    ).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    before = F.sum("cell_size").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("cell_size")
    s = sums.withColumn("cell_before", before).alias("s")
    p = plan.select("source", "rest").alias("p")
    cut_cells = s.join(p, F.col("s.source").eqNullSafe(F.col("p.source"))).where("rest >= cell_before and rest < cell_before + cell_size")
    cut_cells = cut_cells.select(F.col("s.source").alias("c_source"), F.col("cell").alias("c_cell"), "cell_before", "rest")
    k = keyed.join(F.broadcast(cut_cells) if _few(cut_cells) else cut_cells, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("cell") == F.col("c_cell")))
    one = k.groupBy("c_source", "key", "doc_id", "cell_before", "rest").agg(F.sum("size").alias("u"))
    start = F.col("cell_before") + F.sum("u").over(Window.partitionBy("c_source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("u")
    cut = one.withColumn("start", start).where("rest >= start and rest < start + u")
    cut = cut.select("c_source", F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"), (F.col("rest") - F.col("start")).alias("cut_words"), F.col("u").alias("cut_size"))
    return plan.join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source")


def _few(rows: DataFrame) -> bool:
    return rows.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES


def _with_plan(rows: DataFrame, plan: DataFrame, source: str) -> DataFrame:
    plan = durable(plan.select([F.col(c).alias(f"_m_{c}") for c in plan.columns]))
    return rows.join(F.broadcast(plan) if _few(plan) else plan, F.col(source).eqNullSafe(F.col("_m_source")))


def _part(key: Column, doc_id: Column, size: Column) -> Column:
    """Words that the last, partial epoch takes of a document: all before the cut, at the cut its share.

    Keys are a function of the id, so rows stand before the cut by the key alone, ids breaking ties.
    """
    cut, at = F.col("_m_cut_key"), F.col("_m_cut_id").eqNullSafe(doc_id)
    earlier = (key < cut) | ((key == cut) & ~at & (doc_id.isNull() | (doc_id < F.col("_m_cut_id"))))
    here = F.floor(size * F.col("_m_cut_words") / F.col("_m_cut_size")).cast("long")
    # with no cut the rest is 0 words, or all that there is
    return F.when(cut.isNull(), F.lit(0)).when((key == cut) & at, here).when(earlier, size).otherwise(F.lit(0)).cast("long")


def mix_sizes(docs: DataFrame, weights=(3, 1, 2), share=1.5, epochs=2, seed="mix", id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """doc_id, size, source_size, target, taken: what the mix takes of every document, in words.

    Null texts and texts without words have size 0 and are taken 0 times; a null source is a source.
    Rows that repeat a doc_id share one place in the order. An empty table gives no rows.
    """
    sized = durable(_sized(docs, seed, id_col, text_col, source_col))
    plan = mix_plan(sized, 8 * input_partitions(docs), weights, share, epochs)
    size = F.col("size")
    taken = F.col("_m_epochs") * size + _part(F.col("key"), F.col("doc_id"), size)
    return _with_plan(sized, plan, "source").select("doc_id", "size", F.col("_m_source_size").alias("source_size"), F.col("_m_target").alias("target"), taken.cast("long").alias("taken"))


def mix_documents(docs: DataFrame, weights=(3, 1, 2), share=1.5, epochs=2, seed="mix", id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """The mixed documents, all columns kept: a row for each epoch that takes a document.

    The document at a source's cut keeps its first words only, up to the budget, with the line breaks between them. Documents of no
    words and those that the budget doesn't reach are left out. Texts are not shuffled.
    """
    sized = durable(_sized(docs, seed, id_col, text_col, source_col))
    plan = mix_plan(sized, 8 * input_partitions(docs), weights, share, epochs)
    # the row travels as one struct, so that its columns may have any names
    text, doc_id = F.col(f"_m_row.`{text_col}`"), F.col(f"_m_row.`{id_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_m_row"))
    rows = _with_plan(rows.withColumn("_m_key", _key(doc_id, seed)), plan, f"_m_row.`{source_col}`").withColumn("_m_size", F.size(words(text)).cast("long"))
    rows = rows.withColumn("_m_part", _part(F.col("_m_key"), doc_id, F.col("_m_size")))
    whole = F.array_repeat(F.lit(-1).cast("long"), F.when(F.col("_m_size") > 0, F.col("_m_epochs")).otherwise(0).cast("int"))
    part = F.when(F.col("_m_part") > 0, F.array(F.when(F.col("_m_part") >= F.col("_m_size"), F.lit(-1).cast("long")).otherwise(F.col("_m_part"))))
    rows = rows.withColumn("_m_take", F.explode(F.concat(whole, F.coalesce(part, F.array().cast("array<long>")))))
    taken = F.when(F.col("_m_take") < 0, text).otherwise(first_words(text, F.col("_m_take")))
    return rows.select(*[taken.alias(c) if c == text_col else F.col(f"_m_row.`{c}`") for c in docs.columns])


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, what is between the words as it was."""
    pieces = F.split(text, rf"(?<={BLANK[:-1]})(?!{BLANK[:-1]})")  # each a word and the blanks after it, but for blanks at the beginning
    led = text.rlike(rf"\A{BLANK}").cast("int")
    return F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), n.cast("int") + led), ""), rf"{BLANK}\z", "")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
with d as (
  select doc_id, source, md5('mix:' || coalesce(cast(doc_id as varchar), '')) k,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size
  from documents
), t as (
  select source, cast(sum(size) as bigint) source_size,
    [3.0::double, 1.0::double, 2.0::double][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)] w,
    row_number() over (order by source nulls last) pos
  from d group by source
), l as (
  select *, 2.0::double * source_size cap, (2.0::double * source_size) / w ratio, sum(source_size) over () * 1.5::double total from t
), v as (
  select *, (total - coalesce(sum(cap) over (order by ratio, pos rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by ratio, pos rows between current row and unbounded following) lev
  from l
), g as (
  select *, least(cap, coalesce(max(case when lev <= ratio then lev end) over () * w, cap)) target from v
), p as (
  select source, source_size, target, cast(floor(target) as bigint) budget,
    case when source_size > 0 then cast(floor(target) as bigint) // source_size else 0 end e
  from g
), r as (
  select d.doc_id, d.size, p.source_size, p.target, p.e, p.budget - p.e * p.source_size rest,
    sum(d.size) over (partition by d.source order by d.k, d.doc_id rows between unbounded preceding and current row) - d.size st
  from d join p on d.source is not distinct from p.source
)
select doc_id, size, source_size, target,
  cast(e * size + greatest(0, least(size, rest - st)) as bigint) taken
from r
"""
