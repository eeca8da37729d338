"""Line-first quality rules: lines that fail a rule go, then documents that lost too much. DataFrame operations only.

Each line with a word is judged by itself:

- punctuation: it doesn't end as a sentence does, or more than ``symbol_share`` of its characters are symbols,
  or more than ``shout_share`` of its words end in several marks, mixed or not, or in capitals
  and a mark, or it has a doubled mark to more than that share of its words;
- navigation: ``bars`` or more separators as menus and breadcrumbs have them;
- boilerplate: a phrase that notices and widgets consist of, whatever blanks are between its words.

A document is kept if the lines that stay hold at least ``1 - lost_share`` of the characters of its lines, and its base measures don't fail. Everything is counted within the row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, words

#: Marks that end a sentence, with closing quotes and brackets after them.
SENTENCE_END = r"""[.!?:;…。！？]["'”’»)\]]*[\x20\x09-\x0D]*\z"""
#: What may follow the mark: the whole line is looked at only if its last characters are nothing else.
CLOSING = r"""\A["'”’»)\]\x20\x09-\x0D]*\z"""
SHOUTED = r"(?:[!?*]{2,}|[A-Z]{4,}!)(?=[\x20\x09-\x0D]|\z)"
SEPARATORS = "|›»→•·"
SYMBOLS = "#*$%&|<>"
#: Phrases of notices and widgets, lower case.
BOILERPLATE = (
    "cookie policy", "accept cookies", "use cookies", "privacy policy", "terms of use", "terms of service",
    "all rights reserved", "enable javascript", "javascript is disabled", "sign up for our newsletter", "click here to",
    "share this article", "read more", "skip to content", "add to cart", "back to top", "lorem ipsum",
)


def _count(text: Column, *marks: str) -> Column:
    """Occurrences of ASCII marks of one length; what their removal takes off the bytes is cheap to find."""
    return sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(m), F.lit(""))) for m in marks[1:]), F.octet_length(text) - F.octet_length(F.replace(text, F.lit(marks[0]), F.lit("")))) / len(marks[0].encode())


def _shouts(line: Column, share: float) -> Column:
    """Words that end so, or doubled marks anywhere. Neither is there without a mark, so most lines are settled by counting those."""
    marks, pairs, n_words = _count(line, "!", "?", "*"), _count(line, "!!", "??"), F.size(words(line))
    ends = (marks > share * n_words) & (F.size(F.split(line, SHOUTED, -1)) - 1 > share * n_words)
    return (marks > 0) & (ends | ((pairs > 0) & (pairs > share * F.size(F.split(F.trim(line), " ")))))


def _boilerplate(line: Column) -> Column:
    runs = line.contains("  ")
    for blank in "\t\x0b\f\r":
        runs = runs | line.contains(blank)
    low = F.lower(F.when(runs, F.regexp_replace(line, r"\s+", " ")).otherwise(line))

    def found(x):
        phrase = x.contains(BOILERPLATE[0])
        for p in BOILERPLATE[1:]:
            phrase = phrase | x.contains(p)
        return phrase

    return F.exists(F.array(low), found)  # of an array, so that it is made once


def line_fails(line: Column, symbol_share=0.1, shout_share=0.5, bars=3) -> Column:
    tail = F.substring(line, -12, 12)
    return (
        ~(tail.rlike(SENTENCE_END) | (tail.rlike(CLOSING) & line.rlike(SENTENCE_END)))
        | (_count(line, *SYMBOLS) > symbol_share * F.char_length(line))
        | _shouts(line, shout_share)
        | (sum((_count(line, m) for m in SEPARATORS[1:]), _count(line, SEPARATORS[0])) >= bars)
        | _boilerplate(line)
    )


def line_rules(docs: DataFrame, id_col="doc_id", text_col="text", lost_share=0.5, **line_options) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_lines and n_failed_lines (those with a word), cleaned_text (the lines that stay, null if the document goes).

    A null text counts as empty; a text without words fails the base measures. Repeated rows are judged alike.
    """
    text = F.col("_text")
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    base = base.withColumn("_w", words(text))
    base = base.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    n = F.size("_w")
    at = lambda i, k: F.element_at("_h", (i + (k + 1)).cast("int"))
    fives = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[at(i, k) for k in range(5)]))
    base = base.withColumn("_five", F.when(n >= 5, fives).otherwise(F.array().cast("array<bigint>")))
    again = F.size("_five") > F.size(F.array_distinct("_five"))
    base = base.withColumn("_sorted", F.when(again, F.array_sort(F.transform("_five", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    hash_at = lambda i: F.get("_sorted", i)["h"]
    twice = F.transform("_sorted", lambda e, i: F.when(hash_at(i - 1).eqNullSafe(e["h"]) | hash_at(i + 1).eqNullSafe(e["h"]), e["p"]))
    base = base.withColumn("_twice", F.array_sort(F.filter(twice, lambda p: p.isNotNull())))
    steps = F.transform("_twice", lambda p, i: F.least(F.lit(5), F.coalesce(F.get("_twice", i + 1) - p, F.lit(5))))
    repeated = F.when(F.col("_twice").isNull(), F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), lambda a, x: a + x))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = base.withColumn("_lines", lines)
    base = base.withColumn("_good", F.filter("_lines", lambda x: ~line_fails(x, **line_options)))
    base = base.select(
        "doc_id", "_lines", "_good",
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _count(text, *SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.array_join("_good", "\n").alias("_kept_text"),
        (F.char_length(F.array_join("_good", "")) >= (1 - lost_share) * F.char_length(F.array_join("_lines", ""))).alias("_stays"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = ~failed & F.col("_stays")
    return base.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"),
        F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size("_good")).cast("long").alias("n_failed_lines"),
        F.when(kept, F.col("_kept_text")).alias("cleaned_text"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(table(spark, sf_dir, "documents")).drop("cleaned_text")
