"""Repeated runs of lines by a suffix array over line-ID sequences; later copies are deleted.

The lines of all documents, blank ones left out, are sequences of line IDs. Lines that stand only
once in the corpus end every repeated run, so only repeated lines enter the suffixes. Prefix doubling
over the whole corpus: the distinct line IDs are sorted and numbered, which ranks the suffixes by their
first line; in each round the pairs of the ranks at a position and 2^k lines on are sorted and numbered,
which ranks them by their first 2^(k+1) lines. Pairs that stand only once drop out: no
other suffix shares so many lines with theirs.

Suffixes that share their first d lines lie side by side in that order: they are an LCP interval of depth d. It is
told by the ranks of the two overlapping blocks of 2^floor(log2 d) lines that make up d lines. For each position, d is
the least depth that has min_words words, once reading on from there and once back to there; the union
of these intervals' runs is that of all maximal repeated runs of min_words words or more. So no more than
log2(min_words) rounds are asked for. Each interval's first occurrence, by doc_id and
line, stays; the lines of the others go.

DataFrame functions only. Line IDs are 128 bits of hash. Arrays hold the lines of one document; the corpus-wide
steps are grouped sums with partial aggregation, range-partitioned sorts, and joins that adaptive execution
can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents, let, skew_join, staged, unused


def _ranked(distinct: DataFrame, column: str) -> DataFrame:
    """Numbers distinct rows in the order of a column, over all partitions of a global sort; numbers have gaps."""
    return staged(distinct.orderBy(column).withColumn("r", F.monotonically_increasing_id()))


def block_ranks(positions: DataFrame, min_words: int) -> DataFrame:
    """Ranks of repeated blocks of 2^k lines, 2^k up to min_words: (doc, i, k, r) from those of lines, (doc, i, r)."""
    out, k = positions.withColumn("k", F.lit(0)), 0
    while 2 << k <= min_words:
        on = positions.select("doc", (F.col("i") - (1 << k)).alias("i"), F.col("r").alias("s"))
        pairs = staged(positions.join(on, ["doc", "i"]).select("doc", "i", F.struct("r", "s").alias("pair")))
        again = pairs.groupBy("pair").agg(F.count("*").alias("n")).where("n > 1").select("pair")
        positions = staged(skew_join(pairs, _ranked(again, "pair"), "pair", "inner").select("doc", "i", "r"))
        k += 1
        out = out.unionByName(positions.withColumn("k", F.lit(k)))
        if positions.isEmpty():
            break
    return out


def _windows(lines: Column, min_words: int) -> Column:
    """The shortest runs of min_words words from and to each of a document's repeated lines: array<struct<i, j, d, k, pos>>.

    lines is a sorted array<struct<i, pos, w>>; a run's lines follow each other in the document. i is its first line,
    j that of the second of the two blocks of 2^k lines that make up its d lines, pos are its lines' numbers in the text.
    """

    def runs(a: Column, sums: Column) -> Column:
        n = F.size(a)
        index = F.sequence(F.lit(0), n - 1)

        # sums is increasing: the ends and starts of the shortest runs, at most min_words lines away
        def ahead(i: Column) -> Column:
            rest = let(F.get(sums, i) + min_words, lambda goal: F.size(F.filter(F.slice(sums, i + 2, min_words), lambda x: x < goal)))
            return F.struct(i.alias("at"), (i + rest).alias("to"))

        def back(i: Column) -> Column:
            before = F.slice(sums, F.greatest(i - min_words + 2, F.lit(1)), F.least(i + 1, F.lit(min_words)))
            rest = let(F.get(sums, i + 1) - min_words, lambda goal: F.size(F.filter(before, lambda x: x > goal)))
            return F.struct((i - rest).alias("at"), i.alias("to"))

        pairs = F.array_distinct(F.concat(F.transform(index, ahead), F.transform(index, back)))
        whole = F.filter(pairs, lambda p: (p["at"] >= 0) & (p["to"] < n) & (F.get(a, p["to"])["i"] - F.get(a, p["at"])["i"] == p["to"] - p["at"]))

        def told(p: Column) -> Column:
            d = p["to"] - p["at"] + 1
            k = F.char_length(F.bin(d)) - 1
            first = F.get(a, p["at"])["i"]
            pos = F.transform(F.slice(a, p["at"] + 1, d), lambda x: x["pos"])
            return F.struct(first.alias("i"), (first + d - F.pow(F.lit(2.0), k).cast("int")).alias("j"), d.alias("d"), k.alias("k"), pos.alias("pos"))

        return F.transform(whole, told)

    def summed(a: Column) -> Column:
        upto = F.transform(a, lambda x: x["w"])
        totals = let(upto, lambda ws: F.aggregate(ws, F.array(F.lit(0).cast("bigint")), lambda s, w: F.concat(s, F.array(F.element_at(s, -1) + w))))
        return let(totals, lambda sums: runs(a, sums))

    return let(lines, summed)


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines of these numbers; empty if only blank lines are left."""
    left = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(removed, i))
    return let(left, lambda x: F.when(F.exists(x, lambda y: y.rlike(WORD)), F.array_join(x, "\n")).otherwise(""))


def later_copies(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, key, removed, copied_from) of the documents that hold later copies; key hashes the text."""
    if min_words < 1:
        raise ValueError("min_words must be positive")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key")).alias("doc"), text.alias("text"))
    line = lambda x, i: F.struct(i.alias("pos"), F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2")).alias("id"), F.regexp_count(x, F.lit(WORD)).alias("w"))
    split = F.filter(F.transform(F.split("text", "\n", -1), line), lambda x: x["w"] > 0)
    lines = staged(rows.select("doc", F.posexplode(split).alias("i", "x")).select("doc", "i", "x.pos", "x.id", "x.w"))
    often = lines.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    again = staged(skew_join(lines, _ranked(often, "id"), "id", "inner").select("doc", "i", "pos", "w", "r").distinct())
    ranks = block_ranks(again.select("doc", "i", "r"), min_words)
    packed = again.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("i", "pos", "w"))).alias("lines"))
    runs = packed.select("doc", F.explode(_windows(F.col("lines"), min_words)).alias("x")).select("doc", "x.*")
    block = lambda at, name: ranks.select("doc", F.col("i").alias(at), "k", F.col("r").alias(name))
    named = runs.join(block("i", "a"), ["doc", "i", "k"]).join(block("j", "b"), ["doc", "j", "k"])
    intervals = staged(named.select(F.struct("d", "a", "b").alias("interval"), F.struct("doc", "i").alias("place"), "pos"))
    first = intervals.groupBy("interval").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = skew_join(intervals, first, "interval", "inner").where("place > first")
    gone = later.groupBy("place.doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("pos")))).alias("removed"), F.array_sort(F.collect_set("first.doc.doc_id")).alias("copied_from"))
    return gone.select("doc.doc_id", "doc.key", "removed", "copied_from")


def line_dedup(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, removed (line numbers), copied_from (doc_ids
    whose copies stay), text (without the removed lines).

    A run of lines is deleted where it has min_words words or more and stands earlier, by
    (doc_id, line), in the corpus. Lines are compared whole; blank lines don't count and stay, unless
    every line with words goes. Null text counts as empty. Rows that repeat doc_id and text are one
    document, each returned; a null doc_id sorts first. Other columns are ignored; an empty table
    gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("key", F.xxhash64("text"))
    a, b = rows.alias("a"), later_copies(docs, min_words).alias("b")
    out = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")), "left")
    return out.select(
        "a.doc_id",
        (F.regexp_count("a.text", F.lit("\n")) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
        F.coalesce("copied_from", F.array().cast("array<bigint>")).alias("copied_from"),
        F.when(F.col("removed").isNotNull(), without_lines(F.col("a.text"), F.col("removed"))).otherwise(F.col("a.text")).alias("text"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines of later copies. A document whose every line with words is such a copy goes;
    the columns stay as they are. Repeated rows of one doc_id and text are one document, each returned;
    an empty table gives no rows."""
    names = docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    gone = later_copies(docs)
    key, cut = unused(docs, "text_key"), unused(docs, "is_cut")
    rows = docs.withColumn(key, F.xxhash64(text))
    a, b = rows.alias("a"), gone.alias("b")
    out = a.join(b, F.col("a.doc_id").cast("long").eqNullSafe(F.col("b.doc_id")) & (F.col(f"a.{key}") == F.col("b.key")), "left")
    new = F.when(F.col("b.removed").isNotNull(), without_lines(F.col("a.text").cast("string"), F.col("b.removed"))).otherwise(F.col("a.text"))
    out = out.select(*[F.col(f"a.`{c}`") for c in names if c != "text"], new.alias("text"), F.col("b.removed").isNotNull().alias(cut))
    out = out.where(~F.col(cut) | (F.col("text") != ""))
    return out.select(*[F.when(F.col(cut), F.char_length("text").cast("long")).otherwise(F.col("n_chars")).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in names])
