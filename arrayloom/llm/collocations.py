"""Phrase collocations, mined pass by pass with hashed buckets (PCY/DHP) and Apriori pruning.

Pass k reads all texts. It counts phrases of k words exactly, and in the same pass counts those of k + 1 words into a
fixed number of buckets. Both are needed only where they can still be frequent: a phrase of k words is counted if both
its parts of k - 1 words are frequent (Apriori) and its bucket is, and a longer one goes to a bucket only
if both its parts were counted. What tasks know of earlier passes are bitmaps of 2^bits bits, of frequent buckets and of
hashes of frequent phrases, whatever the corpus' size. Bitmaps let through all that is frequent, and some that isn't; exact
counts decide.

Counting runs block by block in tasks, on numbers of words; Spark adds up the counts of phrases. A task's bucket counts
stop at the least count that matters and are sent as ranges of buckets, which are added up as they stream in.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_table, documents, drop_folder, give_back, in_blocks, ship, skew_join
from .shingles import mix

ship(__name__)

#: Bytes of text whose words are in a task's memory at a time.
BLOCK_BYTES = 5_000_000
#: Buckets of a range: their numbers within it fit 16 bits.
RANGE = 1 << 16
#: Bytes that end a piece of text become a word of their own, which no text can hold otherwise.
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz.........")
_COUNTED = "lang string, phrase string, n long, range int, counts binary"


def _tokens(langs: list, texts: list) -> tuple[pa.Array, np.ndarray, np.ndarray, list]:
    """Distinct words, the words' numbers in order of text, their languages' numbers, the languages. Pieces are parted by the word b"."."""
    by = {}
    for lang, text in zip(langs, texts, strict=True):
        by.setdefault("und" if lang is None else lang, []).append(text or b"")
    words, sizes = [], []
    for group in by.values():
        more = b".".join([*group, b""]).translate(_TABLE).replace(b".", b" . ").split()
        sizes.append(len(more))
        words += more
    coded = pa.array(words, pa.binary()).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(by)), sizes), list(by)


def _hash(value: bytes) -> int:
    return xxhash.xxh64_intdigest(value)


def _word_hashes(dictionary: pa.Array, words: np.ndarray, langs: np.ndarray, names: list) -> np.ndarray:
    """A hash of language and word for each word of the text."""
    own = np.fromiter(map(_hash, dictionary.to_pylist()), np.uint64, len(dictionary))
    of_lang = np.fromiter((_hash(x.encode()) for x in names), np.uint64, len(names))
    return mix(own[words] + of_lang[langs] * np.uint64(0x9E3779B97F4A7C15))


def _phrase_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The hashes of the phrases of k words that start at each word but the last k - 1."""
    n = max(len(h) - k + 1, 0)
    if k == 1:
        return h
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total = total * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
    return mix(total)


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _marked(bitmap: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (bitmap[buckets >> 3] >> (buckets & 7).astype(np.uint8)) & 1 == 1


class _Buckets:
    """Counts of 2^bits buckets up to top, as ranges."""

    def __init__(self, bits: int, top: int):
        self.top, self.kind = top, np.uint8 if top < 256 else np.uint32
        self.counts = np.zeros(1 << bits, self.kind)

    def add(self, buckets: np.ndarray) -> None:
        some, n = np.unique(buckets, return_counts=True)
        self.counts[some] = np.minimum(self.counts[some] + n, self.top)

    def ranges(self):
        for k in range(0, len(self.counts), RANGE):
            part = self.counts[k : k + RANGE]
            at = np.flatnonzero(part)
            if len(at) * (2 + part.itemsize) < len(part) * part.itemsize:
                if len(at):
                    yield k // RANGE, b"s" + at.astype(np.uint16).tobytes() + part[at].tobytes()
            else:
                yield k // RANGE, b"d" + part.tobytes()


def _unpacked(data: bytes, kind: type) -> tuple[np.ndarray | slice, np.ndarray]:
    """Places within the range and counts of what ranges() packed."""
    if data[:1] == b"d":
        return slice(None), np.frombuffer(data, kind, offset=1)
    n = (len(data) - 1) // (2 + np.dtype(kind).itemsize)
    return np.frombuffer(data, np.uint16, n, 1), np.frombuffer(data, kind, n, 1 + 2 * n)


def _count(docs: DataFrame, k: int, longest: int, least: int, bits: int, frequent, buckets) -> DataFrame:
    """Pass k: rows of phrases with their counts by block, and of bucket counts of phrases of k + 1 words by task."""

    def run(batches):
        later = None
        for block in in_blocks(batches, BLOCK_BYTES):
            dictionary, words, langs, names = _tokens(block.column(0).to_pylist(), block.column(1).cast(pa.binary()).to_pylist())
            if not len(words):
                continue
            h = _word_hashes(dictionary, words, langs, names)
            stop = pc.index(dictionary, pa.scalar(b".", pa.binary())).as_py()
            whole = words != stop
            for j in range(1, k):
                whole = whole[:-1] & (words[j:] != stop)
            if k > 1:
                part = _marked(frequent.value, _bucket(_phrase_hashes(h, k - 1), bits))
                whole &= part[:-1] & part[1:]
                at = np.flatnonzero(whole)
                whole[at] = _marked(buckets.value, _bucket(_phrase_hashes(h, k)[at], bits))
            at = np.flatnonzero(whole)
            key = langs[at] * len(dictionary) + words[at]
            for j in range(1, k):
                key = np.unique(key, return_inverse=True)[1] * len(dictionary) + words[at + j]
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            phrases = [dictionary.take(pa.array(words[at[first] + j])) for j in range(k)]
            phrase = pc.binary_join_element_wise(*phrases, pa.scalar(b" ", pa.binary())) if k > 1 else phrases[0]
            lang = pa.array(names, pa.string()).take(pa.array(langs[at[first]]))
            yield pa.record_batch([lang, phrase.cast(pa.string()), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=["lang", "phrase", "n", "range", "counts"])
            if k < longest:
                later = later or _Buckets(bits, least)
                both = whole[:-1] & whole[1:]
                if k == 1:
                    both = (words[:-1] != stop) & (words[1:] != stop)
                later.add(_bucket(_phrase_hashes(h, k + 1)[np.flatnonzero(both[: len(h) - k])], bits))
        if later:
            for r, data in later.ranges():
                yield pa.record_batch([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([r], pa.int32()), pa.array([data], pa.binary())], names=["lang", "phrase", "n", "range", "counts"])
        del later
        give_back()

    return docs.select("lang", "text").mapInArrow(run, _COUNTED)


def _bitmap(packed: DataFrame, bits: int, least: int) -> np.ndarray:
    """Which buckets hold least or more, of ranges (range, counts): 2^bits bits come to the driver.

    A task adds up the ranges dealt to it as they stream in, so it holds these alone, however many tasks sent them.
    """
    kind = np.uint8 if least < 256 else np.uint32

    def add(batches):
        sums = {}
        for b in batches:
            for r, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total = sums.setdefault(r, np.zeros(min(RANGE, 1 << bits), kind))
                at, counts = _unpacked(data, kind)
                # no counter passes its limit: neither addend is over least
                total[at] = np.minimum(total[at].astype(np.int64) + counts, least)
        for r, total in sums.items():
            yield pa.record_batch([pa.array([r], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["range", "bits"])

    parts = max(1, min(64, (1 << bits) // RANGE))
    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for row in packed.select("range", "counts").repartition(parts, "range").mapInArrow(add, "range int, bits binary").toArrow().to_pylist():
        out[row["range"] * RANGE // 8 :][: len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    return out


def _frequent_bits(phrases: DataFrame, k: int, bits: int) -> DataFrame:
    """Ranges (range, counts) that hold 1 for the hash of each phrase."""

    def run(batches):
        marks = None
        for b in batches:
            if not b.num_rows:
                continue
            marks = marks or _Buckets(bits, 1)
            dictionary = pa.array(b" ".join(b.column(1).cast(pa.binary()).to_pylist()).split(b" "), pa.binary())
            coded = b.column(0).dictionary_encode()
            words = np.arange(len(dictionary)).reshape(-1, k)
            h = _word_hashes(dictionary, words.ravel(), np.repeat(coded.indices.to_numpy(), k), coded.dictionary.to_pylist())
            marks.add(_bucket(_phrase_hashes(h, k)[::k], bits))
        if marks:
            for r, data in marks.ranges():
                yield pa.record_batch([pa.array([r], pa.int32()), pa.array([data], pa.binary())], names=["range", "counts"])

    return phrases.select("lang", "phrase").mapInArrow(run, "range int, counts binary")


def frequent_phrases(docs: DataFrame, longest: int = 3, least: int = 10, bits: int = 26) -> tuple[DataFrame, DataFrame]:
    """Exact counts of all phrases of 1 to longest words that occur least times or more, and all words by language.

    Returns (lang, phrase, k, n) and (lang, n). Everything is by language, null being "und". bits sets how much the bitmaps tell apart,
    not the result: a task's bucket counts take 2^bits bytes, a bitmap an eighth of it.
    """
    sc = docs.sparkSession.sparkContext
    frequent = buckets = totals = None
    tables = []
    for k in range(1, longest + 1):
        counted, folder = as_table(_count(docs, k, longest, least, bits, frequent, buckets))
        exact = counted.where("range IS NULL")
        if k == 1:
            totals, _ = as_table(exact.groupBy("lang").agg(F.sum("n").alias("n")))
        found, _ = as_table(exact.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
        tables.append(found.select("lang", "phrase", F.lit(k).alias("k"), "n"))
        if k < longest:
            frequent = sc.broadcast(_bitmap(_frequent_bits(found, k, bits), bits, 1))
            buckets = sc.broadcast(_bitmap(counted.where("range IS NOT NULL"), bits, least))
        drop_folder(folder)
    return reduce(DataFrame.union, tables), totals


def _part(words: Column, start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def _looked_up(rows: DataFrame, counts: DataFrame, phrase: str, name: str) -> DataFrame:
    """Adds a phrase's count; rows of one phrase may be very many."""
    key = lambda c: F.struct("lang", F.col(c).alias("phrase"))
    return skew_join(rows.withColumn("part", key(phrase)), counts.select(key("phrase").alias("part"), F.col("n").alias(name)), "part", "inner").drop("part")


#: Counts up to 10^14 keep the products of the score within 38 digits; above, the cast fails instead of rounding.
_EXACT = "decimal(14,0)"


def score() -> Column:
    """floor(10^6 a^2 / (l r)) of the columns a, l and r, exactly."""
    a, l, r = (f"CAST({c} AS {_EXACT})" for c in "alr")
    return F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * ({a} * {a})) DIV ({l} * {r})")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, inside_percent: int = 50, bits: int = 26) -> DataFrame:
    """The first top phrases of 2 to longest words of each language: lang, rank, phrase, a, l, r, n, score.

    a: the phrase's occurrences, at least `least`; l, r: those of its two parts at the cut whose score, floor(10^6 a^2 / (l r)),
    is lowest (ties: the first cut); n: all words of the language. A phrase goes if a longer candidate that holds it has
    inside_percent of its occurrences or more. Null text counts as empty, null lang as "und", repeated rows each count, other
    columns are ignored; ties are ordered by the phrase's bytes; an empty table gives no rows.
    """
    counts, totals = frequent_phrases(docs, longest, least, bits)
    words = counts.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1))
    cuts = words.withColumn("cut", cut).select("lang", "phrase", "k", "a", "cut", _part(F.col("w"), 1, F.col("cut")).alias("first"), _part(F.col("w"), F.col("cut") + 1, F.col("k")).alias("rest"))
    cuts = _looked_up(_looked_up(cuts, counts, "first", "l"), counts, "rest", "r")
    least_cut = F.min(F.struct(score().alias("score"), "cut", "l", "r")).alias("m")
    scored = cuts.groupBy("lang", "phrase", "k", "a").agg(least_cut).select("lang", "phrase", "k", "a", "m.score", "m.l", "m.r")
    # every shorter phrase that a candidate holds, with the largest count of a longer candidate around it
    size, start = F.explode(F.sequence(F.lit(2), F.col("k") - 1)), F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1))
    inner = words.where("k > 2").withColumn("size", size).withColumn("start", start).select("lang", _part(F.col("w"), F.col("start"), F.col("size")).alias("phrase"), F.col("a").alias("around"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    rows = scored.join(inner, ["lang", "phrase"], "left").where(F.col("around").isNull() | (100 * F.col("around") < inside_percent * F.col("a")))
    # the first of each part of a language, then of these: no task sorts a whole language
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", "salt").orderBy(*order)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def _sql_phrases(k: int) -> str:
    phrase = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"SELECT lang, phrase, {k} AS k, count(*) AS n FROM (SELECT lang, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: {phrase})) AS phrase FROM w) GROUP BY ALL"


SQL = (
    r"WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents), "
    r"w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p), "
    f"f AS MATERIALIZED ({' UNION ALL '.join(map(_sql_phrases, (1, 2, 3)))}), "
    "c AS MATERIALIZED (SELECT lang, phrase, k, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10), "
    "cuts AS MATERIALIZED (SELECT lang, phrase, k, a, cut, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)), "
    "s AS (SELECT cuts.*, f1.n AS l, f2.n AS r, 1000000::HUGEINT * a * a // (f1.n::HUGEINT * f2.n) AS score FROM cuts JOIN f f1 ON f1.lang = cuts.lang AND f1.phrase = first JOIN f f2 ON f2.lang = cuts.lang AND f2.phrase = rest), "
    "m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1), "
    "inside AS (SELECT lang, phrase, max(a) AS around FROM (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM c WHERE k = 3) GROUP BY ALL), "
    "kept AS (SELECT m.* FROM m LEFT JOIN inside USING (lang, phrase) WHERE around IS NULL OR 100 * around < 50 * a), "
    "ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score::BIGINT AS score FROM kept QUALIFY rank <= 2000) "
    "SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang) USING (lang)"
)
