"""Interpolated modified Kneser-Ney n-gram model of any order, counted in Spark, mapped by workers.

Words are numbered by falling frequency class. Counting runs block by block: a task sorts the n-grams of its
own texts and sends, for each shard, one packed row of the distinct ones with their counts; a shard's task
merges them. So a frequent n-gram is one entry a task, and a row never holds less than an n-gram: rows
grow with the corpus at most.

An n-gram of the highest order goes to the shard of its middle words. All n-grams that share their first
or their last n-1 words meet there, so the statistics of contexts and the counts of the next lower order
need no other shuffle. The n-grams around frequent words are spread by their last word too; of these
alone the contexts' statistics are added up in a second step. Lower orders count the distinct words
before an n-gram (texts begin with a mark, and n-grams that begin with it keep their own counts).

The model is files in the shared folder, one a shard and order, of sorted hash arrays: 64-bit hashes of n-grams
as offsets of buckets by their first bits and the next 32 bits, then packed counts. Scoring tasks map files when
they need them, a bounded number at a time; the system's page cache holds what is used.

P_k(w | c) = max(a(cw) - D(a(cw)), 0) / S(c) + gamma(c) * P_k-1(w | c without its first word), P_0 = 1 / (V + 1)

a: counts of order k, S(c): their sum after c, D: three discounts an order for counts of 1, 2 and 3 or more,
from the counts of counts; gamma(c): the mass taken off. A context that training hasn't seen backs off fully.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections import Counter, OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop_folder, file_system, in_blocks, shared_dir, ship, worker_cache
from .shingles import mix

ship(__name__)

_KEPT_WORDS = 300_000
_KEYS_A_BLOCK = 2_500_000
_OPEN_FILES = 4096
_PACKED = "kind int, shard long, n long, data binary"
#: Kinds of packed rows: orders count as themselves, contexts of order k as _CONTEXTS + k, words as _WORDS.
_CONTEXTS, _WORDS, _FACTS = 1000, 0, -1


# ---- files -----------------------------------------------------------------------------------


def _write(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Arrays, each from a multiple of 8 bytes on; whole or not at all: a repeated task writes the same bytes again."""
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        for a in arrays:
            raw = np.ascontiguousarray(a).tobytes()
            f.write(raw + bytes(-len(raw) % 8))
    system.move(part, f"{path}/{name}")


def _map(folder: str, name: str) -> np.ndarray:
    """The file's bytes, memory-mapped; from a store that can't be mapped, by way of a temporary file. Empty if there is none."""
    system, path = file_system(folder)
    path = f"{path}/{name}"
    if system.get_file_info(path).type != fs.FileType.File:
        return np.empty(0, np.uint8)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.empty(0, np.uint8)
    with tempfile.TemporaryFile() as copy, system.open_input_stream(path) as f:
        shutil.copyfileobj(f, copy)
        copy.flush()
        return np.memmap(copy, np.uint8, "r") if copy.tell() else np.empty(0, np.uint8)


def write_table(folder: str, name: str, hashes: np.ndarray, values: np.ndarray) -> None:
    """Hashes with a row of counts each. Counts take 2 bits (one column) or 8; those that don't fit are listed apart."""
    if not len(hashes):
        return
    order = np.argsort(hashes)
    hashes, values = hashes[order], values.reshape(len(hashes), -1)[order]
    bits = max(1, (len(hashes) // 8).bit_length())
    offsets = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange(2**bits + 1, dtype=np.uint64))
    rest = (hashes >> np.uint64(32 - bits)).astype(np.uint32)
    width = 2 if values.shape[1] == 1 else 8
    flat = values.ravel() - (width == 2)  # a single count is 1 at least
    most = 2**width - 1
    large = np.flatnonzero(flat >= most)
    small = np.minimum(flat, most).astype(np.uint8)
    if width == 2:
        small = np.pad(small, (0, -len(small) % 4)).reshape(-1, 4)
        small = (small << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    header = np.array([len(hashes), bits, values.shape[1], len(large)], np.int64)
    _write(folder, name, header, offsets.astype(np.uint64 if len(hashes) >= 2**32 else np.uint32), rest, small, large.astype(np.int64), flat[large].astype(np.int64))


class Table:
    """What write_table wrote, mapped."""

    def __init__(self, folder: str, name: str):
        raw = _map(folder, name)
        self.n = 0
        if not len(raw):
            return
        self.n, self.bits, self.columns, large = raw[:32].view(np.int64).tolist()
        at = 32

        def take(dtype, count):
            nonlocal at
            size = count * np.dtype(dtype).itemsize
            out = raw[at : at + size].view(dtype)
            at += size + -size % 8
            return out

        self.offsets = take(np.uint64 if self.n >= 2**32 else np.uint32, 2**self.bits + 1)
        self.rest = take(np.uint32, self.n)
        self.small = take(np.uint8, -(-self.n // 4) if self.columns == 1 else self.n * self.columns)
        self.large, self.values = take(np.int64, large), take(np.int64, large)

    def look_up(self, hashes: np.ndarray, columns: int) -> np.ndarray:
        """The counts of each hash; zeros where it isn't there."""
        out = np.zeros((len(hashes), columns), np.int64)
        if not self.n:
            return out
        bucket = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        rest = (hashes >> np.uint64(32 - self.bits)).astype(np.uint32)
        low, end = self.offsets[bucket].astype(np.int64), self.offsets[bucket + 1].astype(np.int64)
        high = end.copy()
        for _ in range(int((high - low).max(initial=0)).bit_length()):
            middle = (low + high) >> 1
            less = (self.rest[np.minimum(middle, self.n - 1)] < rest) & (low < high)
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
        hit = np.flatnonzero((low < end) & (self.rest[np.minimum(low, self.n - 1)] == rest))
        at = low[hit]
        if columns == 1:
            flat, most = at, 3
            found = ((self.small[at >> 2] >> ((at & 3) << 1).astype(np.uint8)) & 3).astype(np.int64)
        else:
            flat, most = (at[:, None] * columns + np.arange(columns)).ravel(), 255
            found = self.small[flat].astype(np.int64)
        big = np.flatnonzero(found == most)
        found[big] = self.values[np.searchsorted(self.large, flat[big])]
        out[hit] = found.reshape(-1, columns) + (columns == 1)
        return out


# ---- packed rows ---------------------------------------------------------------------------------


def _planes(arrays: list[np.ndarray]) -> bytes:
    """Compressed, byte by byte of the numbers: sorted columns of differences are mostly zeros."""
    return pa.Codec("zstd", compression_level=1).compress(b"".join(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays), asbytes=True)


def _unplaned(data: bytes, n: int, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(data, 8 * n * columns), np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(x.T).view("<u8").ravel() for x in raw]


def packed(columns: list[np.ndarray], values: list[np.ndarray]) -> bytes:
    """Columns sorted one after the other as differences, and values."""
    out, same = [], np.zeros(len(values[0]), bool)
    same[1:] = True
    for c in columns:
        step = np.diff(c.astype(np.uint64), prepend=np.uint64(0))
        out.append(np.where(same, step, c))
        same &= step == 0
    return _planes(out + values)


def unpacked(data: bytes, n: int, columns: int, values: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    found = _unplaned(data, n, columns + values)
    start, out = np.zeros(n, bool), []
    start[:1] = True
    for d in found[:columns]:
        total = np.cumsum(d, dtype=np.uint64)
        at = np.flatnonzero(start)
        base = total[at] - d[at]
        c = total - np.repeat(base, np.diff(np.append(at, n)))
        out.append(c)
        start[1:] |= c[1:] != c[:-1]
    return out, [v.astype(np.int64) for v in found[columns:]]


def summed(columns: list[np.ndarray], values: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns, sorted one column after the other, with the sums of their values."""
    if not len(values):
        return columns, values
    key, used = columns[0].astype(np.uint64), int(columns[0].max()).bit_length()
    for c in columns[1:]:
        b = int(c.max()).bit_length()
        if used + b > 64:
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
            used = int(key.max()).bit_length()
        key, used = (key << np.uint64(b)) | c.astype(np.uint64), used + b
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return [c[order[first]] for c in columns], np.add.reduceat(values[order], first, axis=0)


def sort_order(k: int) -> list[int]:
    """Columns of n-grams of order k as they are sorted: middle words, the first, the last."""
    return [*range(1, k - 1), 0, k - 1] if k > 1 else [0]


def _by_order(columns: list[np.ndarray], values: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct n-grams, sorted by sort_order, with summed values; columns stay in the words' order."""
    turn = sort_order(len(columns))
    found, values = summed([columns[t] for t in turn], values)
    return [found[turn.index(t)] for t in range(len(columns))], values


def _rows(kind: int, shard: np.ndarray, columns: list[np.ndarray], values: list[np.ndarray]):
    """Arrow batches of one packed row a shard; what is sorted stays sorted within it."""
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    cuts = [*np.flatnonzero(np.diff(shard, prepend=-1)).tolist(), len(shard)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        data = packed([c[order[a:b]] for c in columns], [v[order[a:b]] for v in values])
        yield _row(kind, int(shard[a]), b - a, data)


def _row(kind: int, shard: int, n: int, data: bytes):
    return pa.record_batch([pa.array([kind], pa.int32()), pa.array([shard], pa.int64()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["kind", "shard", "n", "data"])


def _shards(batches):
    """(shard, {kind: [(n, data)]}) from rows sorted by shard."""
    now, held = None, {}
    for b in batches:
        for kind, shard, n, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if shard != now:
                if held:
                    yield now, held
                now, held = shard, {}
            held.setdefault(kind, []).append((n, data))
    if held:
        yield now, held


def _joined(rows, columns: int, values: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Packed rows one after the other; values as a matrix."""
    parts = [unpacked(data, n, columns, values) for n, data in rows]
    return [np.concatenate([p[0][i] for p in parts]) for i in range(columns)], np.concatenate([np.stack(p[1], axis=1) for p in parts])


def _grams(rows, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Words in order, and counts, of packed n-grams of order k."""
    turn = sort_order(k)
    columns, values = _joined(rows, k, 1)
    return [columns[turn.index(t)] for t in range(k)], values[:, 0]


def _gram_rows(shard: np.ndarray, columns: list[np.ndarray], counts: np.ndarray):
    return _rows(len(columns), shard, [columns[t] for t in sort_order(len(columns))], [counts])


def _by_shard(rows: DataFrame) -> DataFrame:
    return rows.repartition("shard").sortWithinPartitions("shard")


# ---- words -----------------------------------------------------------------------------------


def split_words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # bytes: A-Z and the ASCII white space only


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.maximum(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), np.uint64(1))  # 0 is END


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Even ranges of the hashes."""
    return (((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _class(counts: np.ndarray) -> np.ndarray:
    """0 for the most frequent: 63 less the number of the highest bit."""
    return 63 - np.floor(np.log2(counts)).astype(np.int64)


class Vocabulary:
    """Numbers and counts of words from the mapped hash arrays; number size is any unseen word.

    The end of a text is the word of hash END; number start stands before a text.
    """

    END = 0

    def __init__(self, folder: str, shards: int, size: int):
        self.size, self.start = size, size + 1
        self.shards = [_map(folder, f"words-{k}").view(np.uint64).reshape(3, -1) for k in range(shards)]  # hashes, counts, numbers
        self.known: dict[bytes, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.known.clear()
        self.number, self.count = self._find(np.array([self.END], np.uint64))  # of known words, the end first

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shard = shard_of(hashes, len(self.shards))
        number, count = np.full(len(hashes), self.size, np.int64), np.zeros(len(hashes), np.int64)
        for k in np.unique(shard):
            own = self.shards[k]
            if not own.shape[1]:
                continue
            at = np.flatnonzero(shard == k)
            place = np.minimum(np.searchsorted(own[0], hashes[at]), own.shape[1] - 1)
            hit = own[0][place] == hashes[at]
            number[at[hit]], count[at[hit]] = own[2][place[hit]], own[1][place[hit]]
        return number, count

    def spell(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Places in number and count of each text's words and its end (place 0)."""
        if len(self.known) > _KEPT_WORDS:
            self._reset()
        known = self.known
        new = list(set().union(*texts).difference(known))
        if new:
            number, count = self._find(word_hashes(new))
            known.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.number, self.count = np.append(self.number, number), np.append(self.count, count)
        return [np.fromiter((*map(known.__getitem__, t), 0), np.int64, len(t) + 1) for t in texts]


# ---- fitting -----------------------------------------------------------------------------------


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]), np.uint64(0x9E3779B97F4A7C15))
    for c in columns:
        h = mix(h + c.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h


def route(before: list[np.ndarray], last: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The shard of n-grams by some of their words, and whether these are so frequent that the last word decides too."""
    spread, h = np.ones(len(last), bool), np.zeros(len(last), np.uint64)
    if before:
        h = gram_hash(before)
        for c in before:
            spread &= (c < model.hot) | (c == model.words + 1)
    h = mix(np.where(spread, gram_hash([h, last]), h))
    return shard_of(h, model.shards), spread


def _deciding(columns: list[np.ndarray], order: int) -> list[np.ndarray]:
    """The words that route an n-gram: its middle in the highest order, else its context."""
    return columns[1:-1] if len(columns) == order else columns[:-1]


def _discounts(n: list[int]) -> list[float]:
    """Chen and Goodman's three discounts of the counts of counts n1..n4; 0.5, 1, 1.5 where they can't be had."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    out = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.0), float(k)) for k, d in enumerate(out, 1)]


class Model:
    """Where a model's files are, and the few numbers that go with them."""

    def __init__(self, folder: str, **facts):
        self.folder = folder
        self.__dict__.update(facts)


def _settled(model: Model, shard: int, columns: list[np.ndarray], counts: np.ndarray):
    """Writes a shard's n-grams of one order and its contexts. Yields rows: figures, and parts of spread contexts."""
    k = len(columns)
    write_table(model.folder, f"order{k}-{shard}", gram_hash(columns), counts)
    facts = np.array([*((counts == c).sum() for c in range(1, 5)), (counts > 2).sum(), counts.sum()], np.int64)
    yield _row(_FACTS, shard, k, facts.tobytes())
    if k == 1 or not len(counts):
        return
    context = gram_hash(columns[:-1])
    first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    stats = np.add.reduceat(np.stack([counts, counts == 1, counts == 2, counts > 2], axis=1).astype(np.int64), first, axis=0)
    spread = route([c[first] for c in _deciding(columns, model.order)], columns[-1][first], model)[1]
    _write_contexts(model, k, shard, context[first][~spread], stats[~spread])
    order = np.argsort(context[first][spread])
    h, stats = context[first][spread][order], stats[spread][order]
    yield from _rows(_CONTEXTS + k, shard_of(h, model.shards), [h], list(stats.T))


def _write_contexts(model: Model, k: int, shard: int, hashes: np.ndarray, stats: np.ndarray, name: str = "contexts") -> None:
    """A context with one n-gram seen once isn't written: it is known from the lower order."""
    many = stats[:, 0] > 1
    write_table(model.folder, f"{name}{k}-{shard}", hashes[many], stats[many])


def fit(docs: DataFrame, order: int = 3, keys_a_shard: int = 2_000_000) -> Model:
    """Counts the texts of docs and writes the model to the shared folder. Null text counts as empty.

    keys_a_shard tokens make a shard of n-grams; it bounds what a task holds. order is 2 at least.
    """
    if order < 2:
        raise ValueError("order must be 2 at least")
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/ngram-lm-{uuid.uuid4().hex}"
    atexit.register(drop_folder, folder)
    texts = docs.select(F.lit(0).alias("i"), F.col("text").cast("string").cast("binary").alias("text"))
    parts = max(1, texts.rdd.getNumPartitions() // 2)

    def count_words(batches):
        counts: Counter[bytes] = Counter()
        ends = 0

        def out():
            words = list(counts)
            h, n = np.append(word_hashes(words), np.uint64(Vocabulary.END)), np.append(np.fromiter(counts.values(), np.int64, len(words)), ends)
            [h], n = summed([h], n)
            h, n = h[n > 0], n[n > 0]
            return _rows(_WORDS, shard_of(h, parts), [h], [n])

        for b in in_blocks(batches, 2_000_000):
            for t in b.column(1):
                counts.update(split_words(t.as_py()))
                ends += 1
            if len(counts) > _KEPT_WORDS:
                yield from out()
                counts, ends = Counter(), 0
        yield from out()

    def merge_words(batches):
        """Keeps a shard's words in a file and tells how many there are of each frequency class."""
        for shard, held in _shards(batches):
            columns, n = _joined(held[_WORDS], 1, 1)
            [h], n = summed(columns, n[:, 0])
            _write(folder, f"counts-{shard}", np.stack([h, n.astype(np.uint64)]))
            classes, size = np.unique(_class(n), return_counts=True)
            yield pa.record_batch([pa.array([shard] * len(classes), pa.int64()), pa.array(classes, pa.int64()), pa.array(size, pa.int64()), pa.array([int(n[_class(n) == c].sum()) for c in classes], pa.int64())], names=["shard", "class", "n", "total"])

    # 64 rows a shard at most
    sizes = sorted((r[1], r[0], r[2], r[3]) for r in _by_shard(texts.mapInArrow(count_words, _PACKED)).mapInArrow(merge_words, "shard long, class long, n long, total long").collect())
    words, total = sum(x[2] for x in sizes), sum(x[3] for x in sizes)
    shards = max(1, -(-total // keys_a_shard))
    frequent = _class(np.array([max(1, total // (4 * shards))]))[0]
    hot = sum(x[2] for x in sizes if x[0] <= frequent)  # words with a smaller number than this are frequent
    first: dict[int, dict[int, int]] = {}
    at = 0
    for c, shard, n, _ in sizes:
        first.setdefault(shard, {})[c] = at
        at += n
    model = Model(folder, order=order, words=words, total=total, parts=parts, shards=shards, hot=hot)

    def number_words(batches):
        for b in batches:
            for shard in b.column(0).to_pylist():
                h, n = _map(folder, f"counts-{shard}").view(np.uint64).reshape(2, -1)
                number = np.zeros(len(h), np.uint64)
                classes = _class(n.astype(np.int64))
                for c, start in first.get(shard, {}).items():
                    own = np.flatnonzero(classes == c)
                    number[own] = start + np.arange(len(own))
                _write(folder, f"words-{shard}", np.stack([h, n, number]))
                yield pa.record_batch([pa.array([shard], pa.int64())], names=["id"])

    spark.range(0, parts, 1, parts).mapInArrow(number_words, "id long").count()

    def count_grams(batches):
        v = worker_cache(f"vocabulary {folder}", lambda: Vocabulary(folder, parts, words))
        held, size = [], 0

        def out():
            flat = np.concatenate(held)
            place = np.concatenate([np.arange(len(t)) for t in held])  # 0: the mark before the text
            for k in range(2, order + 1):
                ends = np.flatnonzero(place >= k - 1 if k == order else place == k - 1)  # lower orders: only from the mark on
                columns, n = _by_order([flat[ends - k + 1 + i] for i in range(k)], np.ones(len(ends), np.int64))
                if len(n):
                    yield from _gram_rows(route(_deciding(columns, order), columns[-1], model)[0], columns, n)

        for b in in_blocks(batches, 2_000_000):
            for t in v.spell([split_words(t) for t in b.column(1).to_pylist()]):
                held.append(np.concatenate(([v.start], v.number[t])).astype(np.uint64))
                size += len(t)
            if size > _KEYS_A_BLOCK:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    def passed_on(shard, held, done):
        for kind, rows in held.items():
            if kind not in done:
                yield from (_row(kind, shard, n, data) for n, data in rows)

    def lower(shard, columns):
        """Rows that count the distinct words before what follows the first word."""
        below, n = _by_order(columns[1:], np.ones(len(columns[0]), np.int64))
        return _gram_rows(route(_deciding(below, order), below[-1], model)[0], below, n)

    def write_highest(batches):
        """The highest order and the next, whose n-grams are in the same shards; sends on the one below that."""
        for shard, held in _shards(batches):
            none = [(np.empty(0, np.uint64)), np.empty(0, np.int64)]
            columns, n = _by_order(*_grams(held[order], order)) if order in held else ([none[0]] * order, none[1])
            yield from _settled(model, shard, columns, n)
            more, m = _grams(held[order - 1], order - 1) if order - 1 in held else ([none[0]] * (order - 1), none[1])
            columns, n = _by_order([np.concatenate(x) for x in zip(columns[1:], more, strict=True)], np.concatenate([np.ones(len(n), np.int64), m]))
            yield from _settled(model, shard, columns, n)
            if order > 2 and len(n):
                yield from lower(shard, columns)
            yield from passed_on(shard, held, (order, order - 1))

    def write_lower(k: int):
        def run(batches):
            for shard, held in _shards(batches):
                if k in held:
                    columns, n = _by_order(*_grams(held[k], k))
                    yield from _settled(model, shard, columns, n)
                    if k > 1:
                        yield from lower(shard, columns)
                yield from passed_on(shard, held, (k,))

        return run

    def write_spread(batches):
        """Contexts whose n-grams were spread over shards; the figures of all orders go on."""
        for shard, held in _shards(batches):
            for kind, rows in held.items():
                if kind > _CONTEXTS:
                    columns, stats = _joined(rows, 1, 4)
                    [h], stats = summed(columns, stats)
                    _write_contexts(model, kind - _CONTEXTS, shard, h, stats, "spread")
                else:
                    for k, data in rows:
                        yield pa.record_batch([pa.array([k], pa.int32()), *(pa.array([x], pa.int64()) for x in np.frombuffer(data, np.int64).tolist())], names=["order", "n1", "n2", "n3", "n4", "more", "total"])

    rows = _by_shard(texts.mapInArrow(count_grams, _PACKED)).mapInArrow(write_highest, _PACKED)
    for k in range(order - 2, 0, -1):
        rows = _by_shard(rows).mapInArrow(write_lower(k), _PACKED)
    facts = _by_shard(rows).mapInArrow(write_spread, "order int, n1 long, n2 long, n3 long, n4 long, more long, total long").groupBy("order").agg(*(F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "more", "total")))
    of = {r[0]: list(r[1:]) for r in facts.collect()}  # a row an order
    model.discounts = {k: _discounts(of.get(k, [0] * 6)[:4]) for k in range(1, order + 1)}
    n1, n2, _, _, more, model.lowest = of.get(1, [0] * 6)
    model.mass = sum(d * n for d, n in zip(model.discounts[1], (n1, n2, more), strict=True)) / model.lowest if model.lowest else 1.0
    return model


# ---- scoring -----------------------------------------------------------------------------------


class Scorer:
    """Looks up what a block of texts needs, each distinct n-gram once; at most _OPEN_FILES files are mapped at a time."""

    def __init__(self, model: Model):
        self.m = model
        self.v = Vocabulary(model.folder, model.parts, model.words)
        self.open: OrderedDict[str, Table] = OrderedDict()

    def _table(self, name: str) -> Table:
        if name in self.open:
            self.open.move_to_end(name)
        else:
            if len(self.open) >= _OPEN_FILES:
                self.open.popitem(last=False)
            self.open[name] = Table(self.m.folder, name)
        return self.open[name]

    def _look_up(self, name: str, shard: np.ndarray, hashes: np.ndarray, columns: int) -> np.ndarray:
        out = np.zeros((len(hashes), columns), np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = [*np.flatnonzero(np.diff(shard[order], prepend=-1)).tolist(), len(order)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            at = order[a:b]
            out[at] = self._table(f"{name}-{shard[at[0]]}").look_up(hashes[at], columns)
        return out

    def _counts(self, columns: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
        shard = route(_deciding(columns, self.m.order), columns[-1], self.m)[0]
        return self._look_up(f"order{len(columns)}", shard, hashes, 1)[:, 0]

    def _contexts(self, columns: list[np.ndarray], hashes: np.ndarray, k: int) -> np.ndarray:
        """S and the numbers of n-grams seen once, twice and more often after seen contexts of order k."""
        decide = columns[1:] if k == self.m.order else columns
        shard, spread = route(decide, columns[0], self.m)
        out = np.zeros((len(hashes), 4), np.int64)
        out[~spread] = self._look_up(f"contexts{k}", shard[~spread], hashes[~spread], 4)
        out[spread] = self._look_up(f"spread{k}", shard_of(hashes[spread], self.m.shards), hashes[spread], 4)
        out[out[:, 0] == 0] = (1, 1, 0, 0)
        return out

    def log10(self, flat: np.ndarray, place: np.ndarray) -> np.ndarray:
        """log10 P of every word of texts laid end to end, each behind its mark (place 0)."""
        m = self.m
        p, before = np.zeros(len(flat)), None
        for k in range(1, m.order + 1):
            ends = np.flatnonzero(place >= k - 1)
            hashes, index, number = np.unique(gram_hash([flat[ends - k + 1 + i] for i in range(k)]), return_index=True, return_inverse=True)
            at = ends[index]
            columns = [flat[at - k + 1 + i] for i in range(k)]
            counts = self._counts(columns, hashes)
            taken = np.maximum(counts - np.array([0.0, *m.discounts[k]])[np.minimum(counts, 3)], 0)
            if k == 1:
                p = taken[number] / max(1, m.lowest) + m.mass / (m.words + 1)
                seen = (counts > 0) | ((columns[0] == m.words + 1) & (m.total > 0))
            else:
                # the context of the n-gram at i is the shorter n-gram that ends at i - 1
                sums, gamma, seen, number_of = before
                c = number_of[ends - 1]
                known = seen[c]
                p[ends] = np.where(known, taken[number] / sums[c] + gamma[c] * p[ends], p[ends])
                seen = counts > 0
            if k < m.order:
                stats = np.ones((len(hashes), 4), np.int64)
                some = np.flatnonzero(seen)
                stats[some] = self._contexts([c[some] for c in columns], hashes[some], k + 1)
                number_of = np.zeros(len(flat), np.int64)
                number_of[ends] = number
                before = stats[:, 0], stats[:, 1:] @ np.array(m.discounts[k + 1]) / stats[:, 0], seen, number_of
        return np.log10(p)

    def score(self, texts: list[bytes | None]) -> list[tuple[int, int, float, float]]:
        """(tokens, known tokens, base score, model's log10 probability) of each text."""
        m, v = self.m, self.v
        spelled = v.spell([split_words(t) for t in texts])
        lengths = np.array([len(x) for x in spelled])
        starts = np.cumsum(lengths) - lengths
        words = np.concatenate(spelled)
        counts = v.count[words]
        base = np.log10((counts + 1) / (m.total + m.words + 1))
        flat = np.concatenate([np.append(v.start, v.number[x]) for x in spelled]).astype(np.uint64)
        place = np.concatenate([np.arange(n + 1) for n in lengths])
        own = self.log10(flat, place)[place > 0]
        return list(zip(lengths.tolist(), np.add.reduceat((counts > 0).astype(np.int64), starts).tolist(), np.add.reduceat(base, starts).tolist(), np.add.reduceat(own, starts).tolist(), strict=True))


def score(docs: DataFrame, model: Model, block_bytes: int = 4_000_000) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Null and empty texts have one token, the end. Repeated rows each return a row; other
    columns are ignored; an empty table gives no rows. A model without training texts gives every
    word the probability 1 / (V + 1), V = 0.
    """

    def run(batches):
        scorer = worker_cache(f"scorer {model.folder}", lambda: Scorer(model))
        for b in in_blocks(batches, block_bytes):
            n, known, base, own = zip(*scorer.score(b.column(1).to_pylist()), strict=True)
            perplexity = 10 ** (-np.array(own) / np.array(n))
            yield pa.record_batch(
                [b.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([model.total] * len(n), pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64()), pa.array(perplexity, pa.float64())],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
