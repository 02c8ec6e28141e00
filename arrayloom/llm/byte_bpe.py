"""Byte-level BPE by merge replay over the distinct words of a block of documents.

The words of a block that aren't known yet are laid end to end. An inverted index leads from a
pair's rank to the positions where that pair stands. Ranks are taken in order; each merge of a rank
touches its own position and re-indexes only the pairs with the left and right neighbour.
Documents are then spelled out from the words' ids. Known words are kept from block to block.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, in_blocks, ship, tokenizer_path, worker_cache

ship(__name__)

_KEPT_WORDS = 500_000
_SHIFT = 24


class MergeReplay:
    """Encodes and decodes by a table of ranks (token bytes -> rank, which is also its id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pair_rank = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    self.pair_rank[a << _SHIFT | b] = rank
        self.byte_pairs = np.full((256, 256), -1, np.int64)
        for a in range(256):
            for b in range(256):
                self.byte_pairs[a, b] = self.pair_rank.get(int(self.first[a]) << _SHIFT | int(self.first[b]), -1)
        self.known: dict[str, bytes] = {}

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian 32-bit integers."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        inner = np.ones(len(raw), bool)
        inner[ends - 1] = False
        at = np.flatnonzero(inner)
        rank = self.byte_pairs[raw[at], raw[at + 1]]
        at, rank = at[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank, prepend=-1))
        index = {int(rank[c]): p.tolist() for c, p in zip(cuts, np.split(at, cuts[1:]), strict=True)} if len(rank) else {}
        heap = sorted(index)

        symbol = array("i", self.first[raw].astype(np.int32).tobytes())
        place = np.arange(len(raw), dtype=np.int32)
        after = array("i", np.where(inner, place + 1, -1).astype(np.int32).tobytes())
        starts = np.zeros(len(raw), bool)
        starts[0], starts[ends[:-1]] = True, True
        before = array("i", np.where(starts, -1, place - 1).astype(np.int32).tobytes())
        get = self.pair_rank.get
        while heap:
            r = heappop(heap)
            todo = index.pop(r)
            todo.sort()
            for k, p in enumerate(todo):
                q = after[p]
                if q < 0 or symbol[p] < 0 or get(symbol[p] << _SHIFT | symbol[q]) != r:
                    continue
                symbol[p], symbol[q] = r, -1
                n = after[p] = after[q]
                left = before[p]
                if n >= 0:
                    before[n] = p
                    new = get(r << _SHIFT | symbol[n])
                    if new is not None:
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            heappush(heap, new)
                if left >= 0:
                    new = get(symbol[left] << _SHIFT | r)
                    if new is not None:
                        if new in index:
                            index[new].append(left)
                        else:
                            index[new] = [left]
                            heappush(heap, new)
                if heap and heap[0] < r and k + 1 < len(todo):  # an earlier merge has become possible
                    index[r] = todo[k + 1 :]
                    heappush(heap, r)
                    break
        ids = np.frombuffer(symbol, np.int32)
        live = ids >= 0
        cut = np.cumsum(live)[ends - 1]
        packed = ids[live].astype("<u4").tobytes()
        bounds = [0, *(cut * 4).tolist()]
        return [packed[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        if len(self.known) > _KEPT_WORDS:
            self.known.clear()
        new = list(set().union(*split).difference(self.known))
        if new:
            self.known.update(zip(new, self.replay([w.encode() for w in new]), strict=True))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f))}


def _replay(path: str | None, pattern: str | None) -> MergeReplay:
    import public_tokenizers

    return MergeReplay(load_ranks(path or tokenizer_path("byte_bpe_50k.tiktoken")), pattern or public_tokenizers.PATTERN)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, ids array<int>): ids of every whole text, without special tokens; null counts as empty."""

    def run(batches):
        coder = worker_cache(f"byte-bpe {path} {pattern}", lambda: _replay(path, pattern))
        for b in in_blocks(batches, block_chars):
            ids = coder.encode([t or "" for t in b.column(1).to_pylist()])
            yield pa.record_batch([b.column(0), pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, bytes binary) of (doc_id, ids); null ids give null bytes."""

    def run(batches):
        coder = worker_cache(f"byte-bpe {path} {pattern}", lambda: _replay(path, pattern))
        for b in batches:
            out = [None if x is None else coder.decode(np.array(x, "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return ids.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, in one pass without a shuffle.

    Null and empty texts have no tokens. Repeated rows each return a row; other columns are
    ignored; an empty table gives no rows. Memory holds one block of texts and a bounded table of words.
    """

    def run(batches):
        coder = worker_cache(f"byte-bpe {path} {pattern}", lambda: _replay(path, pattern))
        for b in in_blocks(batches, block_chars):
            ids = coder.encode([t or "" for t in b.column(1).to_pylist()])
            yield pa.record_batch(
                [
                    b.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
