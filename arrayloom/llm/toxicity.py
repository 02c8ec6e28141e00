"""Toxicity by the nearest labelled examples, exact under TF-IDF cosine.

Fitting takes a bounded sample of labelled rows (max_examples, in hash order of the id, at the labels'
own rate). Copies with the same label count once. The terms are all words of the examples; words and beginnings
of words whose documents are toxic more often than chance allows (binomial tail, Bonferroni-corrected;
max_terms of them at most) weigh _BOOST times as much. Document frequencies of all terms are counted
over the whole corpus. Every example that holds a word is in the index.

The cosine with every example is computed: terms that many examples hold are rows of a matrix, the
others have postings. So a text's k neighbours are exact. They vote with a weight that rises with the
cosine, steeply near 1, so that a copy of a labelled text outweighs texts that are merely alike; votes
become probabilities by isotonic regression on the examples, each scored without itself. The
neighbours are the evidence.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_table, documents, give_back, ship, staged
from .shingles import coefficients, mix, signature

ship(__name__)

#: Lower-cases A-Z and turns ASCII punctuation into spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
_COORDINATES = 16
_VOTERS = 15
#: Texts scored at a time, and the share of the examples from which on a term is a matrix row.
_BLOCK = 64
_COMMON = 1 / 12
#: Weight of terms that come with toxic texts, next to other words.
_BOOST = 12.0
#: Weight of the base rate among the votes.
_PRIOR_WEIGHT = 0.05
#: A neighbour votes with s*s / (1 + _NEARLY - s), s being its cosine.
_NEARLY = 0.02


_KEPT_WORDS = 300_000
_STEMS = (4, 5, 6, 7)
_TIMES = 4


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def terms_of_word(word: bytes) -> list[bytes]:
    """The word, and its beginnings marked with a dash."""
    letters = word.decode("utf-8", "replace")
    return [word, *((letters[:k] + "-").encode() for k in _STEMS if len(letters) > k)]


class Bags:
    """Counts of a text's terms; what each word stands for is kept up to a bound.

    A term that stands in a text n times also makes the terms "n times" for n = 2, 3, 4: a cosine
    alone can't tell a stem that recurs from one that stands there by chance.
    """

    def __init__(self):
        self.known = {}

    def __call__(self, text: bytes | None) -> dict[bytes, int]:
        out: dict[bytes, int] = {}
        known = self.known
        if len(known) > _KEPT_WORDS:
            known.clear()
        for w, n in Counter(words_of(text)).items():
            terms = known.get(w)
            if terms is None:
                terms = known[w] = tuple(terms_of_word(w))
            for t in terms:
                out[t] = out.get(t, 0) + n
        return out | {b"%b*%d" % (t, k): 1 for t, n in out.items() if n > 1 for k in range(2, min(n, _TIMES) + 1)}


class Numbered:
    """Numbers and counts of those of a text's terms that are among the given ones, as arrays.

    Words are terms of their own, which no other word stands for, and are looked up at once. Only words that
    begin like one of the given beginnings, or have marks, are looked at one by one.
    """

    def __init__(self, number: dict[bytes, int]):
        self.number, self.marks, self.marked = number, {}, {}
        for t, i in number.items():
            if b"*" in t:
                stem, _, k = t.partition(b"*")
                self.marks.setdefault(stem, []).append((int(k), i))
        # a term that is there for its marks only has a number of its own while counting
        only = {t: len(number) + k for k, t in enumerate(t for t in self.marks if t not in number)}
        place = lambda t: only[t] if t in only else number[t]
        self.stems = {t[:-1]: place(t) for t in [*number, *only] if t.endswith(b"-")}
        self.heads = {t[: _STEMS[0]] for t in self.stems}
        self.marked = {t: place(t) for t in self.marks if not t.endswith(b"-")}
        self.marks = {place(t): x for t, x in self.marks.items()}

    def _begun(self, word: bytes) -> list[int]:
        """Numbers of the word's beginnings."""
        starts = [word[:k] for k in _STEMS if len(word) > k] if word.isascii() else [t[:-1] for t in terms_of_word(word)[1:]]
        return [self.stems[x] for x in starts if x in self.stems]

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        words, heads, first = Counter(words_of(text)), self.heads, _STEMS[0]
        t = np.fromiter(map(self.number.get, words, repeat(-1)), np.int32, len(words))
        n = np.fromiter(words.values(), np.int32, len(words))
        out: dict[int, int] = {}
        for w in [w for w in words if w[:first] in heads]:
            for i in self._begun(w):
                out[i] = out.get(i, 0) + words[w]
        if self.marks:
            counted = [*out.items(), *((self.marked[w], words[w]) for w in self.marked.keys() & words.keys())]
            out |= {i: 1 for x, c in counted for k, i in self.marks.get(x, ()) if c >= k}
        if out:
            t = np.concatenate((t, np.fromiter(out.keys(), np.int32, len(out))))
            n = np.concatenate((n, np.fromiter(out.values(), np.int32, len(out))))
        kept = (t >= 0) & (t < len(self.number))
        t, n = t[kept], n[kept]
        order = np.argsort(t)
        return t[order], n[order]


def packed_terms(terms: list[bytes]) -> bytes:
    """Terms hold no white space."""
    return zlib.compress(b" ".join(terms), 1)


def unpacked_terms(packed: bytes) -> dict[bytes, int]:
    return {t: i for i, t in enumerate(zlib.decompress(packed).split(b" ")) if t}


def _log_tail(k: int, x: int, p: float) -> float:
    """Natural logarithm of a bound on P(binomial(k, p) >= x) for x/k > p (Chernoff)."""
    a = x / k
    kl = a * math.log(a / p) + ((1 - a) * math.log((1 - a) / (1 - p)) if a < 1 else 0.0)
    return -k * kl


def distinct_examples(signatures: list[bytes], labels: list[int]) -> list[int]:
    """Indices of texts whose words aren't those of an earlier one with the same label, by MinHash.

    All coordinates must agree, so only copies go; alike texts with different labels both stay.
    """
    first: dict[tuple[bytes, int], int] = {}
    for i, x in enumerate(zip(signatures, labels, strict=True)):
        first.setdefault(x, i)
    return list(first.values())


def word_signature(text: bytes | None) -> bytes:
    values = np.array([xxhash.xxh3_64_intdigest(w) for w in set(words_of(text))], np.uint64)
    return signature(mix(values), *coefficients(_COORDINATES)).tobytes()


def choose_terms(counts: list[tuple[bytes, int, int]], toxic: int, total: int, n_terms: int, max_terms: int, risk: float = 0.01) -> list[bytes]:
    """Of (term, texts, toxic texts): terms that come with toxic texts more often than chance, the surest first.

    A term that stands in the same texts as a chosen one of the same beginning is left out.
    """
    rate, limit = (toxic + 0.5) / (total + 1), math.log(risk / max(1, n_terms))
    scored = [(_log_tail(n, x, rate), t, n, x) for t, n, x in counts if x >= 4 and x > n * min(0.9, 3 * rate)]
    out, same = [], {}
    for s, t, n, x in sorted(scored, key=lambda r: (r[0], -len(r[1]), r[1])):
        if s >= limit or len(out) == max_terms:
            break
        stem = t.rstrip(b"-") if b"*" not in t else t
        if not any(u.startswith(stem) or stem.startswith(u) for u in same.get((n, x), ())):
            out.append(t)
            same.setdefault((n, x), []).append(stem)
    return out


class ExampleIndex:
    """Unit TF-IDF vectors of examples: common terms as a matrix, the others as postings."""

    def __init__(self, terms: list[bytes], idf: np.ndarray, vectors: list[dict[int, float]], labels: list[int], ids: list[int]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.idf, self.labels, self.ids = idf, np.array(labels, np.float64), ids
        self.size = len(vectors)
        self.raw_at, self.value = np.array([0.0]), np.array([0.0])
        self.base = self.silent = 0.0
        pairs = [v if isinstance(v, tuple) else _arrays(v) for v in vectors]
        term = np.concatenate([np.empty(0, np.int32), *(t for t, _ in pairs)])
        weight = np.concatenate([np.empty(0), *(w for _, w in pairs)])
        order = np.argsort(term, kind="stable")
        self.weight = weight[order]
        self.example = np.repeat(np.arange(self.size, dtype=np.int32), [len(t) for t, _ in pairs])[order]
        self.held = np.bincount(term, minlength=len(terms))
        self._lay_out()

    def _lay_out(self) -> None:
        held, size = self.held, self.size
        self.since = np.concatenate(([0], np.cumsum(held)))
        common = np.flatnonzero(held > max(_BLOCK, size * _COMMON))
        self.row = np.full(len(held), -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), size))
        for r, t in enumerate(common):
            part = slice(self.since[t], self.since[t + 1])
            self.matrix[r, self.example[part]] = self.weight[part]

    def __getstate__(self):
        """Small enough to be sent: single precision, without what can be derived."""
        out = {k: v for k, v in self.__dict__.items() if k not in ("number", "matrix", "row", "since")}
        small = np.uint16 if self.size <= 2**16 else np.int32
        return out | {"terms": packed_terms(list(self.number)), "example": self.example.astype(small), "weight": self.weight.astype(np.float32), "held": self.held.astype(np.int32), "idf": self.idf.astype(np.float32)}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.number = unpacked_terms(self.__dict__.pop("terms"))
        self.example, self.idf = self.example.astype(np.int32), self.idf.astype(np.float64)
        self._lay_out()

    def vector(self, bag: dict[bytes, int]) -> dict[int, float]:
        v = {self.number[t]: (1 + math.log(n)) for t, n in bag.items() if t in self.number}
        v = {t: w * self.idf[t] for t, w in sorted(v.items())}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / norm for t, w in v.items()} if norm else {}

    def unit(self, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms, sorted, and their weights from their counts."""
        return unit(self.idf, t, n)

    def cosines(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """With every example, a row a vector."""
        q, rows = np.zeros((len(vectors), len(self.matrix))), [self.row[t] for t, _ in vectors]
        for x, r, (_, w) in zip(q, rows, vectors, strict=True):
            x[r[r >= 0]] = w[r >= 0]
        out, since, example, weight = q @ self.matrix, self.since, self.example, self.weight
        for x, r, (t, w) in zip(out, rows, vectors, strict=True):
            rest = t[r < 0]
            if len(rest):
                lists = [slice(a, b) for a, b in zip(since[rest].tolist(), since[rest + 1].tolist(), strict=True)]
                parts = np.repeat(w[r < 0], self.held[rest]) * np.concatenate([weight[a] for a in lists])
                x += np.bincount(np.concatenate([example[a] for a in lists]), parts, self.size)
        return out

    def all_nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = _VOTERS, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """The k best (cosine, example) of each vector, exactly, by falling cosine and then example number."""
        out = []
        for start in range(0, len(vectors), _BLOCK):
            score = self.cosines(vectors[start : start + _BLOCK])
            for i, x in enumerate(score, start):
                if without is not None and without[i] >= 0:
                    x[without[i]] = 0.0
                least = np.partition(x, -k)[-k] if len(x) > k else 0.0
                best = np.flatnonzero((x >= least) & (x > 0))
                best = best[np.argsort(-x[best], kind="stable")[:k]]
                out.append([(min(float(x[p]), 1.0), int(p)) for p in best])
        return out

    def nearest(self, v: dict[int, float], k: int = _VOTERS, without: int = -1) -> list[tuple[float, int]]:
        return self.all_nearest([_arrays(v)], k, [without])[0]

    def vote(self, near: list[tuple[float, int]]) -> float:
        up, down = self.base * _PRIOR_WEIGHT, _PRIOR_WEIGHT
        for s, i in near:
            w = s * s / (1 + _NEARLY - s)
            up += w * self.labels[i]
            down += w
        return up / down

    def calibrate(self, raw: list[float], toxic: list[int]) -> None:
        """Isotonic regression of the labels on the votes, smoothed by one observation of the base rate."""
        pools: list[list[float]] = []
        for r, y in sorted(zip(raw, toxic, strict=True)):
            pools.append([r, y, 1, r])
            while len(pools) > 1 and (pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2] or pools[-2][3] == pools[-1][0]):
                low, high = pools[-2], pools.pop()
                low[1], low[2], low[3] = low[1] + high[1], low[2] + high[2], high[3]
        if pools:
            self.raw_at = np.array([(p[0] + p[3]) / 2 for p in pools])
            self.value = np.array([(p[1] + self.base) / (p[2] + 1) for p in pools])

    def scores(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[tuple[float, int]]]]:
        near = self.all_nearest([self.unit(*bag) for bag in bags])
        return [(float(np.clip(np.interp(self.vote(x), self.raw_at, self.value), 0, 1)) if x else self.silent, x) for x in near]


def unit(idf: np.ndarray, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = (1 + np.log(n)) * idf[t]
    return t, w / math.sqrt(w @ w) if len(w) else w


def _arrays(v: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(v.keys(), np.int32, len(v)), np.fromiter(v.values(), np.float64, len(v))


def bags_of(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, terms, counts): numbers and counts of each text's terms among the given ones, as bytes."""
    sent = docs.sparkSession.sparkContext.broadcast(packed_terms(terms))  # bounded by max_examples and their words

    def run(batches):
        bag = Numbered(unpacked_terms(sent.value))
        for b in batches:
            bags = [bag(t.as_py()) for t in b.column(1)]
            yield pa.record_batch([b.column(0), *(pa.array([x[k].tobytes() for x in bags], pa.binary()) for k in (0, 1))], names=["doc_id", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "doc_id long, terms binary, counts binary")


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = 16_384, max_terms: int = 4_096) -> ExampleIndex:
    """The index of fit_with_bags."""
    return fit_with_bags(docs, labels, max_examples, max_terms)[0]


def fit_with_bags(docs: DataFrame, labels: DataFrame, max_examples: int = 16_384, max_terms: int = 4_096) -> tuple[ExampleIndex, DataFrame]:
    """The index, and the bags of all docs under its terms, a table, so that texts are cut into words once to be counted and scored.

    An index of at most max_examples labelled rows; document frequencies come from all of docs.

    What reaches the driver is bounded by max_examples and their distinct words.
    """
    labelled = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))

    def signed(batches):
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array([word_signature(t.as_py()) for t in b.column(2)], pa.binary())], names=["doc_id", "toxic", "text", "sig"])

    sample = staged(texts.join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text").dropDuplicates(["doc_id"]).mapInArrow(signed, "doc_id long, toxic int, text binary, sig binary"))
    rows = sorted(sample.select("doc_id", "sig", "toxic").collect())  # max_examples rows of 64 bytes
    kept = {rows[i][0] for i in distinct_examples([bytes(r[1]) for r in rows], [int(r[2] > 0) for r in rows])}

    def counting(batches):
        bag, n = Bags(), {}
        for b in batches:
            for i, y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if i in kept:
                    for term in bag(t.as_py()):
                        x = n.setdefault(term, [0, 0])
                        x[0] += 1
                        x[1] += y > 0
            if len(n) > _KEPT_WORDS:
                yield told(n)
                n = {}
        yield told(n)

    def told(n):
        return pa.record_batch([pa.array(n.keys(), pa.binary()), pa.array([x[0] for x in n.values()], pa.int64()), pa.array([x[1] for x in n.values()], pa.int64())], names=["term", "n", "x"])

    terms_in = staged(sample.select("doc_id", "toxic", "text").mapInArrow(counting, "term binary, n long, x long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("x").alias("x")))
    n_terms = terms_in.count()
    likely = terms_in.where("x >= 4").orderBy(F.col("x") * F.col("x") / F.col("n"), "term", ascending=False).limit(16 * max_terms)
    counts = [(bytes(r[0]), r[1], r[2]) for r in likely.collect()]
    among = [r for r in sample.where("toxic IS NOT NULL").select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).collect() if r[0] in kept]
    chosen = choose_terms(counts, sum(r[1] for r in among), len(among), n_terms, max_terms)
    words = terms_in.where(~F.col("term").cast("string").rlike("[-*]")).select("term").toArrow().column(0).to_pylist()  # the examples' words
    terms = chosen + sorted(set(words).difference(chosen))
    bags, _ = as_table(bags_of(docs, terms))
    n_known = len(terms)

    def frequencies(batches):
        df, n = np.zeros(n_known, np.int64), 0
        for b in batches:
            n += b.num_rows
            df += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32), minlength=n_known)
        seen = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(seen, -1), pa.int32()), pa.array(np.append(df[seen], n), pa.int64())], names=["term", "df"])

    counted = bags.select("terms").mapInArrow(frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row a term
    df = np.zeros(len(terms) + 1)  # the last is the number of documents
    df[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    idf[: len(chosen)] *= _BOOST

    rows = bags_of(sample.where("toxic IS NOT NULL").select("doc_id", "text"), terms).toArrow()
    held = {i: k for k, i in enumerate(rows.column(0).to_pylist()) if i in kept}
    among.sort()

    def counts_of(i):
        return tuple(np.frombuffer(rows.column(c)[held[i]].as_py(), np.int32) for c in (1, 2))

    some = [(i, y) for i, y in among if len(counts_of(i)[0])]
    index = ExampleIndex(terms, idf, [unit(idf, *counts_of(i)) for i, _ in some], [y for _, y in some], [i for i, _ in some])
    index.base = (sum(y for _, y in among) + 0.5) / (len(among) + 1)
    quiet = [y for i, y in among if not len(counts_of(i)[0])]
    index.silent = (sum(quiet) + index.base) / (len(quiet) + 1)
    place = {i: k for k, i in enumerate(index.ids)}
    del rows, words, terms, some, counted
    give_back()  # the driver's JVM needs the room
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def voted(batches):
        """Votes on the examples, each without itself."""
        model = sent.value
        bag = Numbered(model.number)
        for b in batches:
            own = [(place[i], t.as_py()) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) if i in place]
            near = model.all_nearest([model.unit(*bag(t)) for _, t in own], without=[k for k, _ in own])
            out = [(k, model.vote(x)) for (k, _), x in zip(own, near, strict=True) if x]
            yield pa.record_batch([pa.array([k for k, _ in out], pa.int32()), pa.array([v for _, v in out], pa.float64())], names=["k", "vote"])

    votes = sorted(sample.select("doc_id", "text").mapInArrow(voted, "k int, vote double").collect())  # max_examples rows
    index.calibrate([v for _, v in votes], [int(index.labels[k]) for k, _ in votes])
    sent.destroy()
    give_back()
    return index, bags


def score(docs: DataFrame, index: ExampleIndex, threshold: float = 0.7, bags: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, score, predicted, evidence (neighbours' doc_id, cosine, toxic).

    Texts without a word of the examples, null and empty ones among them, get the rate of toxic
    texts among examples without words. Repeated rows each return a row; other columns are ignored;
    an empty table gives no rows; without labels every score is 0.5. bags: those of docs, if they are there already.
    """
    held = docs.sparkSession.sparkContext.broadcast(index)  # bounded by max_examples and their words

    def run(batches):
        model = held.value
        for b in batches:
            counts = [tuple(np.frombuffer(x, np.int32) for x in bag) for bag in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            p, near = zip(*model.scores(counts), strict=True) if b.num_rows else ((), ())
            told = [[{"doc_id": model.ids[i], "cosine": s, "toxic": int(model.labels[i])} for s, i in x[:3]] for x in near]
            yield pa.record_batch(
                [b.column(0), pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32()), pa.array(told, pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())])))],
                names=["doc_id", "score", "predicted", "evidence"],
            )

    bags = bags_of(docs, list(index.number)) if bags is None else bags
    return bags.mapInArrow(run, "doc_id long, score double, predicted int, evidence array<struct<doc_id: long, cosine: double, toxic: int>>")


def held_out(doc_id="doc_id", parts: int = 3, part: int = 1):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    index, bags = fit_with_bags(docs, labels.where(~held_out()))
    return score(docs, index, bags=bags).select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")
