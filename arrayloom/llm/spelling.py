"""Spelling variants: words one edit apart, found by two-dimensional range reporting.

An edit at position i of a word leaves what is before it and what is behind it. Of the words of one length in forward order,
those with the prefix are an interval; in reverse order, those with the suffix are one. The words with both are the points of a
rectangle, which a wavelet tree of the permutation between the two orders reports. Replacements look for words of the same length,
insertions for words that are one longer; a deletion is the other side of an insertion.

Spark deals words out so that all that an index needs is in one task. Two words whose edit is in the second half of the
longer one agree on its first half, and the other way round; so a word goes to the groups of both its halves, and as a candidate for
an insertion to those of the words that are one longer. A group of too many words is split by halving the part that the edit may
be in again, down to single positions, where a group holds no more words than there are letters. A pair belongs to one
group, and is found there once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_table, bounded_broadcast, documents, drop_folder, ship, skew_join

ship(__name__)

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_KEPT_WORDS = 400_000
#: Words that an index is made for at a time, more or less: groups are split until none has more.
INDEX_WORDS = 100_000


# ---- words -----------------------------------------------------------------------------------


def corpus_words(docs: DataFrame, shortest: int = 6, least: int = 5, drop_every: int = 0) -> DataFrame:
    """(word, n) of the lower-cased letter runs of at least `shortest` code points that occur `least` times or more.

    With drop_every, a run whose crc32 with its document's id is a multiple of it loses the code point that the crc32 names. Null
    texts have no words; a null id counts as an empty one; every row counts, repeated ones too; other columns are ignored.
    """
    pattern = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}")

    def batch(counts):
        return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        counts = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1).cast(pa.binary()), strict=True):
                text = text.as_py()
                if not text:
                    continue
                i = doc_id.as_py()
                start = zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode()))
                for word, n in Counter(pattern.findall(text.translate(_LOWER).decode())).items():
                    if drop_every:
                        h = zlib.crc32(word.encode(), start)
                        if not h % drop_every:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                            if len(word) < shortest:
                                continue
                    counts[word] += n
                if len(counts) > _KEPT_WORDS:
                    yield batch(counts)
                    counts = Counter()
        if counts:
            yield batch(counts)

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# ---- the index -------------------------------------------------------------------------------


class WaveletTree:
    """A permutation of 0..n-1, a row of bits a level with the ranks of its zeros; nodes of a level lie in order of value."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for bit in reversed(range(max(1, int(len(values) - 1).bit_length()))):
            ones = (values >> bit) & 1 == 1
            zeros = np.concatenate([[0], np.cumsum(~ones)])
            self.levels.append((bit, zeros))
            values = np.concatenate([values[~ones], values[ones]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every rectangle of places left..right-1 and values low..high-1 the values in it: (rectangle, value)."""
        q, v = np.arange(len(left)), np.zeros(len(left), np.int64)
        for bit, zeros in self.levels:
            zl, zr = zeros[left], zeros[right]
            some0 = (zl < zr) & (low[q] < v + (1 << bit))
            some1 = (left - zl < right - zr) & (high[q] > v + (1 << bit))
            shift = zeros[-1]
            left, right = np.concatenate([zl[some0], (shift + left - zl)[some1]]), np.concatenate([zr[some0], (shift + right - zr)[some1]])
            q, v = np.concatenate([q[some0], q[some1]]), np.concatenate([v[some0], v[some1] + (1 << bit)])
        inside = (v >= low[q]) & (v < high[q])
        return q[inside], v[inside]


def _refined(groups: np.ndarray, columns: np.ndarray) -> list[np.ndarray]:
    """Ranks by group and the first k columns, for every k: each keeps the order of the one before."""
    ranks = [groups]
    for k in range(columns.shape[1]):
        key = ranks[-1].astype(np.int64) * 0x110000 + columns[:, k]
        ranks.append(np.unique(key, return_inverse=True)[1])
    return ranks


class _Order:
    """Entries in an order, with the intervals that they have in it; intervals count the entries of the dictionary."""

    def __init__(self, groups: np.ndarray, columns: np.ndarray, listed: np.ndarray):
        self.ranks = _refined(groups, columns)
        self.order = np.argsort(self.ranks[-1], kind="stable")
        self.before = np.concatenate([[0], np.cumsum(listed[self.order])])
        self.dictionary = self.order[listed[self.order]]

    def interval(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each entry, where the entries of the dictionary that share its group and first k columns begin and end."""
        rank = self.ranks[k]
        ordered = rank[self.order]
        return self.before[np.searchsorted(ordered, rank, "left")], self.before[np.searchsorted(ordered, rank, "right")]


def _codes(words: list[str], size: int) -> np.ndarray:
    return np.array(words, f"U{size}").view(np.uint32).reshape(len(words), size)


def near_pairs(size: int, low: int, high: int, groups: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of places in words, in both directions, that are one edit apart within low..high-1 and in one group.

    Words have `size` code points, or one less. A group's words agree on what is outside that part.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    listed = lengths == size
    codes = np.zeros((len(words), size), np.uint32)
    for n in (size, size - 1):
        at = np.flatnonzero(lengths == n)
        if len(at):
            codes[at, :n] = _codes([words[k] for k in at], n)
    depth = high - 1 - low
    # what is behind an edit lies one place further left in the shorter words
    shifted = np.where(listed[:, None], codes[:, low + 1 : high][:, ::-1], codes[:, low : high - 1][:, ::-1])
    forward, backward = _Order(groups, codes[:, low : high - 1], listed), _Order(groups, shifted, listed)
    if not len(forward.dictionary):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place = np.empty(len(words), np.int64)
    place[backward.dictionary] = np.arange(len(backward.dictionary))
    tree = WaveletTree(place[forward.dictionary])
    a, b = [], []
    for i in range(low, high):
        (left, right), (bottom, top) = forward.interval(i - low), backward.interval(depth - (i - low))
        few = listed.astype(np.int64)  # a listed word always finds itself
        at = np.flatnonzero((right - left > few) & (top - bottom > few))
        q, v = tree.report(left[at], right[at], bottom[at], top[at])
        q, x = at[q], backward.dictionary[v]
        same = listed[q]
        # an insertion into a run of equal letters is taken at its first place
        first = same | (i == 0) | (codes[q, max(i - 1, 0)] != codes[x, i])
        good = np.where(same, q != x, first)
        q, x, same = q[good], x[good], same[good]
        a += [q, x[~same]]
        b += [x, q[~same]]
    return np.concatenate(a), np.concatenate(b)


_ENTRY = ("size", "low", "high", "context", "word", "n")
_GROUP = ("size", "low", "high", "context")


def _context(low: Column, high: Column, size: Column) -> Column:
    """What all of a group agrees on: the size tells how long the first part is. The rest of a shorter word begins one place earlier."""
    return F.concat(F.substr("word", F.lit(1), low), F.substr("word", high + F.when(F.char_length("word") == size, 1).otherwise(0)))


def _halves(rows: DataFrame) -> DataFrame:
    """Rows with a part low..high, by both halves of it."""
    low, high, middle = F.col("low"), F.col("high"), F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    ends = F.array(F.struct(low.alias("low"), middle.alias("high")), F.struct(middle.alias("low"), high.alias("high")))
    split = rows.withColumn("half", F.explode(ends)).withColumn("low", F.col("half.low")).withColumn("high", F.col("half.high"))
    return split.where("low < high").withColumn("context", _context(F.col("low"), F.col("high"), F.col("size"))).select(*_ENTRY)


def _dealt(words: DataFrame, most: int) -> tuple[DataFrame, int, list[str]]:
    """Entries in groups of at most `most` words (more only at a single position), their number, folders to drop."""
    n = F.char_length("word")
    sizes = words.withColumn("size", F.explode(F.array(n, n + 1))).withColumn("low", F.lit(0)).withColumn("high", F.col("size"))
    live, parts, folders = sizes.withColumn("context", F.lit("")).select(*_ENTRY), [], []
    while True:
        live, folder = as_table(_halves(live))
        folders.append(folder)
        large, folder = as_table(live.groupBy(*_GROUP).count().where((F.col("count") > most) & (F.col("high") - F.col("low") > 1)).drop("count"))
        folders.append(folder)
        if large.isEmpty():
            parts.append(live)
            break
        large = bounded_broadcast(large)
        parts.append(live.join(large, [*_GROUP], "left_anti"))
        live = live.join(large, [*_GROUP], "left_semi")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out, out.count(), folders


def near_words(words: DataFrame, most: int = INDEX_WORDS) -> DataFrame:
    """words(word, n), distinct -> (word, n_near, best, best_n): how many words are one edit away, and the most frequent of them.

    Ties go to the word that is first in code-point order. Words without a near one are absent.
    """
    entries, total, folders = _dealt(words, most)

    def run(batches):
        some = [b for b in batches if b.num_rows]
        if not some:
            return
        table = pa.Table.from_batches(some)
        kinds = np.stack([table[c].to_numpy() for c in ("size", "low", "high")], axis=1)
        context = table["context"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        word, n = np.array(table["word"].to_pylist(), object), table["n"].to_numpy()
        kind, of = np.unique(kinds, axis=0, return_inverse=True)
        by = np.argsort(of.ravel(), kind="stable")
        for k, at in enumerate(np.split(by, np.cumsum(np.bincount(of.ravel()))[:-1])):
            # alone in its group, a word has no near one
            group = np.unique(context[at], return_inverse=True)[1]
            several = np.bincount(group)[group] > 1
            at, group = at[several], group[several]
            if not len(at):
                continue
            some = word[at].tolist()
            a, b = near_pairs(*kind[k].tolist(), group, some)
            if not len(a):
                continue
            rank = np.empty(len(some), np.int64)
            rank[sorted(range(len(some)), key=some.__getitem__)] = np.arange(len(some))
            order = np.lexsort((rank[b], -n[at][b], a))
            a, b = a[order], b[order]
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            counts = np.diff(np.append(first, len(a)))
            columns = [pa.array(word[at][a[first]].tolist(), pa.string()), pa.array(counts, pa.int64()), pa.array(word[at][b[first]].tolist(), pa.string()), pa.array(n[at][b[first]], pa.int64())]
            yield pa.record_batch(columns, names=["word", "n_near", "best", "best_n"])

    parts = max(1, -(-total // most))
    found = entries.repartition(parts, *_GROUP).mapInArrow(run, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("b")
    out, _ = as_table(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.m")).alias("best_n")))
    for folder in folders:
        drop_folder(folder)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """forms(word, form), without cycles -> (word, root): the last word that the forms lead to. Each round halves the ways."""
    found = forms.select("word", F.col("form").alias("root"))
    while True:
        found, _ = as_table(found)
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if found.join(further, "root", "left_semi").isEmpty():
            return found
        found = skew_join(found, further, "root").select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(words: DataFrame, ratio: int = 5, most: int = INDEX_WORDS) -> DataFrame:
    """words(word, n), distinct -> word, form, root, n, n_near, form_n.

    A word's form is the most frequent word one edit away (ties: the first in code-point order) if that is ratio times as frequent or
    more, else null; its root is where forms lead. An empty table gives no rows.
    """
    words, _ = as_table(words.select("word", "n"))
    rows = words.join(near_words(words, most), "word", "left")
    has = F.col("best_n") >= ratio * F.col("n")
    rows, _ = as_table(rows.select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best_n")).alias("form_n")))
    rows = rows.join(roots(rows.where("form IS NOT NULL")), "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(corpus_words(documents(spark, sf_dir), drop_every=199))


#: A byte's crc32 step from its rule, a word's bytes (letters up to U+00FF), and pairs by patterns with one place left open.
_CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
_BYTES = "flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + unicode(x) // 64, 128 + unicode(x) % 64]::BIGINT[] END))"
SQL = (
    f"WITH RECURSIVE crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS tab), "
    "runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL), "
    f"h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1])), 4294967295) AS h FROM runs, crc), "
    "v AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h), "
    "w AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM v WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5), "
    "p AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w), "
    "o AS (SELECT word, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM p), "
    "pairs AS (SELECT x.word, y.word AS near FROM o x JOIN o y USING (i, a, b) WHERE x.word <> y.word UNION SELECT o.word, w.word FROM o JOIN w ON w.word = a || b UNION SELECT w.word, o.word FROM o JOIN w ON w.word = a || b), "
    "best AS (SELECT pairs.word, near, w.n AS near_n, count(*) OVER (PARTITION BY pairs.word) AS n_near FROM pairs JOIN w ON w.word = near QUALIFY row_number() OVER (PARTITION BY pairs.word ORDER BY w.n DESC, near) = 1), "
    "f AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM w LEFT JOIN best USING (word)), "
    "r AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL) "
    "SELECT f.word, f.form, coalesce(l.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN (SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL) l ON l.word = f.word"
)
