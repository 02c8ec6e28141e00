"""Near duplicates: inverted join over MinHash coordinates, exact confirmation, components.

1. Documents with one and the same shingle set form a class; the smallest doc_id stands for it.
2. Each class posts itself under 32 tokens, each of them the values of two of the 64 coordinates. A pair of
   sets with Jaccard similarity s agrees in a binomial(64, s) number of coordinates and in a binomial(32, s * s)
   number of tokens; pairs with at least min_matches and min_pairs are candidates. Texts that only share
   common words agree in single coordinates, the more of them the larger the corpus is, but hardly in tokens.
   Counting starts from short lists: with tokens in order of rising frequency, a pair with that many matches
   meets in the first 32 - min_pairs + 1 tokens of both (prefix); the long lists after it are skipped, and the pair is
   probed by one byte a coordinate.
3. Candidates are gathered into clusters: every posting links its members to its most central one,
   by signature. In postings that still hold several clusters, all that isn't in the largest one is compared in
   blocks with everything, which returns a spanning forest of the candidate pairs and not the pairs.
4. Large clusters are compared with a few representatives first, exactly, a row a member and representative;
   what hangs together by them is one part. Then all that isn't in the largest part is compared in blocks with
   everything: full shingle sets are intersected as a matrix product over the shingles that two or more
   of them hold. So no link is left out, copies aren't expanded into pairs, no group meets in one task,
   and copies of one text cost rows in proportion to their number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_table, bounded_broadcast, documents, give_back, ship, skew_join
from .components import connected_components
from .shingles import WordHashes, coefficients, mix, shingle_set, signature

ship(__name__)

COORDINATES = 64
PAIRS = COORDINATES // 2
_SIGNED = "doc_id long, n long, set_hash binary, sig binary"


def _table(df: DataFrame) -> DataFrame:
    return as_table(df)[0]


def _sign(width: int):
    def run(batches):
        a, b = coefficients(COORDINATES)
        hashes = WordHashes()
        for batch in batches:
            n, key, sig = [], [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py(), width, hashes)
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(signature(s, a, b).tobytes() if len(s) else None)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n", "set_hash", "sig"])
        hashes.clear()
        give_back()

    return run


def _matrix(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, COORDINATES)


def _post(batches):
    """Rows (doc, token). 40 bits tell tokens apart well enough, and the other bytes take no room in a shuffle."""
    place = mix(np.arange(1, PAIRS + 1, dtype=np.uint64))
    for b in batches:
        if b.num_rows:
            sig = _matrix(b.column(1), np.uint32).astype(np.uint64)
            token = mix((sig[:, ::2] << np.uint64(32) | sig[:, 1::2]) ^ place) >> np.uint64(24)
            yield pa.record_batch([pa.array(np.repeat(b.column(0).to_numpy(), PAIRS)), pa.array(token.ravel().astype(np.int64))], names=["doc", "token"])


def _add_probe(batches):
    """Rows with a byte of each coordinate: equal coordinates stay equal, one of 256 others looks so."""
    for b in batches:
        sig = mix(_matrix(b.column(3), np.uint32).astype(np.uint64)).astype(np.uint8)
        yield pa.record_batch([*b.columns, pa.array([x.tobytes() for x in sig], pa.binary())], names=["set_hash", "doc_id", "n", "sig", "probe"])


def _groups(batches, keys: int):
    """(key, columns as lists) of rows sorted by their first columns, over batch borders."""
    key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        cuts = np.zeros(b.num_rows, bool)
        for i in range(keys):
            x = b.column(i).to_numpy(zero_copy_only=False)
            cuts[1:] |= x[1:] != x[:-1]
        starts = [0, *np.flatnonzero(cuts).tolist()]
        for start, end in zip(starts, [*starts[1:], b.num_rows], strict=True):
            part = b.slice(start, end - start)
            now = tuple(part.column(i)[0].as_py() for i in range(keys))
            if now != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(part)
    if held:
        yield key, pa.Table.from_batches(held)


def _forest(linked: np.ndarray, doc: np.ndarray) -> tuple[list, list]:
    """Edges from the smallest doc of each component of a boolean matrix to its other docs."""
    a, b, left = [], [], np.ones(len(doc), bool)
    for i in np.argsort(doc):
        if left[i]:
            left[i] = False
            front = np.array([i])
            while len(front):
                new = np.flatnonzero(linked[front].any(axis=0) & left)
                left[new] = False
                a += [int(doc[i])] * len(new)
                b += doc[new].tolist()
                front = new
    return a, b


def _edges(found):
    """Arrow batches of (a, b), of about the same size."""
    a, b = [], []
    for x, y in found:
        a += x
        b += y
        if len(a) > 10_000:
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _sizes_allow(n: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n[:, None], n) >= percent * np.maximum(n[:, None], n)


def _agreeing(min_matches: int, percent: int):
    """Rows (token, p, q, doc, n, probe): a forest of the candidate pairs in each block pair."""

    def one(table):
        doc, n = (table.column(i).to_numpy() for i in (3, 4))
        probe = _matrix(table.column(5), np.uint8)
        same = np.zeros((len(doc), len(doc)), np.uint8)
        for k in range(COORDINATES):
            same += probe[:, k, None] == probe[:, k]
        return _forest((same >= min_matches) & _sizes_allow(n, percent), doc)

    return lambda batches: _edges(one(t) for _, t in _groups(batches, 3))


def _similar(sets: list[np.ndarray], percent: int, width: int = 4096) -> np.ndarray:
    """Which pairs of sets have the Jaccard similarity, exactly."""
    n = np.array([len(x) for x in sets], np.int64)
    value, place = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), n)
    often = np.bincount(place, minlength=len(value)) > 1
    number = np.cumsum(often) - 1
    keep = often[place]
    row, col = row[keep], number[place[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = int(often.sum())
    common = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, total, width):
        a, b = np.searchsorted(col, (start, start + width))
        x = np.zeros((len(sets), min(width, total - start)), np.float32)
        x[row[a:b], col[a:b] - start] = 1
        common += x @ x.T  # whole numbers under 2**24: exact
    common = common.astype(np.int64)
    return 100 * common >= percent * (n[:, None] + n - common)


def _linked(shingles: int, percent: int):
    """Rows (c, p, q, doc, text): a forest of the links in each block pair of a cluster."""

    def run(batches):
        hashes = WordHashes()

        def one(table):
            doc = table.column(3).to_numpy()
            return _forest(_similar([shingle_set(t, shingles, hashes) for t in table.column(4).to_pylist()], percent), doc)

        yield from _edges(one(t) for _, t in _groups(batches, 3))
        hashes.clear()
        give_back()

    return run


def _compared(width: int, percent: int):
    """Rows (a, b, text of a, text of b): the pairs that are similar. Rows of one a follow each other."""

    def run(batches):
        hashes = WordHashes()
        last, own = None, None
        for batch in batches:
            a, b = [], []
            for x, y, t, u in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if t != last:
                    last, own = t, shingle_set(t, width, hashes)
                other = shingle_set(u, width, hashes)
                common = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * common >= percent * (len(own) + len(other) - common):
                    a.append(x)
                    b.append(y)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _block_pairs(members: DataFrame, group: str, block: int, block_shingles: int) -> DataFrame:
    """Deals members(group, part, doc, n, ...) to pairs (p, q) of blocks, by documents and by shingles.

    Any two members of a group meet in a pair, unless both are in its largest part. A group of one block
    is the pair (0, 0); one of a single part isn't dealt.
    """
    parts = members.groupBy(group, "part").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    sizes = parts.groupBy(group).agg(F.max(F.struct("m", "s", "part")).alias("top"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.count("*").alias("parts")).where("parts > 1")
    number = lambda m, s: F.greatest(F.ceil(m / block), F.ceil(s / block_shingles), F.lit(1)).cast("int")
    main = number(F.col("top.m"), F.col("top.s"))
    sizes = sizes.select(group, F.col("top.part").alias("largest"), F.when(number(F.col("m"), F.col("s")) == 1, 0).otherwise(main).alias("main"), number(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s")).alias("rest"))
    out = skew_join(members, sizes, group, "inner")
    inside = (F.col("part") == F.col("largest")) & (F.col("main") > 0)
    own = F.when(inside, F.pmod(F.xxhash64("doc"), F.col("main"))).otherwise(F.col("main") + F.pmod(F.xxhash64("doc"), F.col("rest"))).cast("int")
    other = F.sequence(F.when(inside, F.col("main")).otherwise(0), F.col("main") + F.col("rest") - 1)
    out = out.withColumn("own", own).withColumn("other", F.explode(other))
    rest = [c for c in members.columns if c not in (group, "part", "n")]
    return out.select(group, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "doc", "n", *(c for c in rest if c != "doc"))


def _marked(rows: DataFrame, docs: DataFrame, bits: int = 26) -> DataFrame:
    """rows(doc, text) whose doc is in docs(doc), and a few others; joins by doc that follow are exact.

    No text is shuffled: tasks get a bitmap of hashed ids, 2^bits bits, and at most twice as much comes to the driver.
    """
    place = F.pmod(F.xxhash64("doc"), F.lit(1 << bits))
    marks = docs.select(place.alias("p")).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, int(p & 63))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bitmap = np.zeros(1 << bits - 6, np.int64)
    bitmap[marks.column(0).to_numpy()] = marks.column(1).to_numpy()
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for b in batches:
            p = b.column(2).to_numpy()
            yield b.select([0, 1]).filter(pa.array(bitmap.value[p >> 6] >> (p & 63) & 1 == 1))

    return rows.select("doc", "text", place.alias("p")).mapInArrow(run, "doc long, text binary")


def _by_representatives(members: DataFrame, texts: DataFrame, width: int, percent: int, rounds: int = 2) -> DataFrame:
    """Edges (a, b) between representatives of clusters (c, doc) and the members they are linked with.

    A representative is drawn by hash from those that aren't linked with an earlier one. Each
    round sends every member's text once at most, whatever the cluster's size; none if the representatives are few.
    """
    edges, open_, own = None, members, _table(texts.join(bounded_broadcast(members.select("c", "doc")), "doc"))
    for k in range(rounds):
        heads = _table(open_.groupBy("c").agg(F.min(F.struct(F.xxhash64("doc", F.lit(k)), "doc"))["doc"].alias("a")))
        if heads.isEmpty():
            break
        of_heads = _table(own.join(heads.withColumnRenamed("a", "doc"), ["c", "doc"]).select("c", F.col("doc").alias("a"), F.col("text").alias("head")))
        pairs = skew_join(own, of_heads, "c", "inner").where("a != doc").select("a", F.col("doc").alias("b"), "head", "text")
        found = _table(pairs.sortWithinPartitions("a").mapInArrow(_compared(width, percent), "a long, b long"))
        edges = found if edges is None else edges.unionByName(found)
        done = found.select(F.col("b").alias("doc")).union(heads.select("a"))
        open_ = _table(open_.join(done.distinct(), "doc", "left_anti"))
    return edges


def near_components(docs: DataFrame, width: int = 5, percent: int = 80, min_matches: int = 34, min_pairs: int = 5, block: int = 1024, block_shingles: int = 2_000_000) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Null and blank texts have an empty set and link with nothing. Rows that repeat a doc_id each
    return a row, with their own n_shingles; they are one document, linked with all that any of its texts is
    similar to. A null doc_id is linked with nothing (component null, kept false). Other
    columns are ignored; an empty table gives no rows. Blocks hold about block documents and
    block_shingles shingles; a longer text makes a block of its own.

    min_matches 34 of 64 and min_pairs 5 of 32 let a pair at similarity 0.80 through with probability above 1 - 1e-6
    (it misses the first with 3.2e-7, the second with 2.5e-9).
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    signed = _table(docs.mapInArrow(_sign(width), _SIGNED))
    some = signed.where("doc_id IS NOT NULL AND set_hash IS NOT NULL")
    classes = some.groupBy("set_hash").agg(F.min(F.struct("doc_id", "n", "sig")).alias("m")).select("set_hash", "m.*")
    classes = _table(classes.mapInArrow(_add_probe, "set_hash binary, doc_id long, n long, sig binary, probe binary"))
    known = docs.where("doc_id IS NOT NULL")

    tokens = classes.select("doc_id", "sig").mapInArrow(_post, "doc long, token long")
    often = tokens.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    shared = skew_join(tokens, often, "token", "inner")
    room = PAIRS - min_pairs + 1
    lists = shared.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("t"))  # 32 at most
    lists = lists.withColumn("shared", F.aggregate("t", F.lit(0.0), lambda s, x: s + F.log2(x["f"].cast("double"))))
    prefix = F.slice("t", 1, F.greatest(F.lit(0), room - (PAIRS - F.size("t"))))
    postings = _table(lists.select("doc", "shared", F.explode(prefix).alias("x")).select("doc", "shared", "x.token"))

    probes = classes.select(F.col("doc_id").alias("doc"), "n", "probe")
    heads = postings.groupBy("token").agg(F.max(F.struct("shared", (-F.col("doc")).alias("doc")))["doc"].alias("a"))
    stars = skew_join(postings, heads.select("token", (-F.col("a")).alias("a")), "token", "inner").where("a != doc").select(F.least("a", "doc").alias("a"), F.greatest("a", "doc").alias("b")).distinct()
    stars = _table(_enough(stars, probes, min_matches, percent))
    near = connected_components(stars)

    placed = skew_join(postings, near.select(F.col("v").alias("doc"), "c"), "doc").select("token", "doc", F.coalesce("c", "doc").alias("c"))
    state = placed.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("who")).where("lo < hi")
    open_ = state.groupBy("m", "who", "lo", "hi").agg(F.min("token").alias("token")).select("token", "m")  # equal lists once
    mixed = skew_join(skew_join(placed, open_, "token", "inner").select("token", "c", "doc"), probes, "doc", "inner").select("token", F.col("c").alias("part"), "doc", "n", "probe")
    dealt = _block_pairs(mixed, "token", block, 64 * block_shingles).repartition("token", "p", "q").sortWithinPartitions("token", "p", "q")
    more = _table(dealt.mapInArrow(_agreeing(min_matches, percent), "a long, b long").distinct())
    if not more.isEmpty():
        near = connected_components(near.select(F.col("c").alias("a"), F.col("v").alias("b")).unionByName(more))
    clusters = near.select("c", F.col("v").alias("doc"))

    texts = _table(_marked(known.select(F.col("doc_id").alias("doc"), "text"), clusters.select("doc")))
    weighed = skew_join(clusters, probes.groupBy("doc").agg(F.max("n").alias("n")), "doc", "inner")
    sizes = clusters.groupBy("c").agg(F.count("*").alias("m"))
    large = _table(skew_join(clusters, sizes.where(F.col("m") > block // 2), "c", "inner").select("c", "doc"))
    parted, links = weighed.withColumn("part", F.col("doc")), None
    if not large.isEmpty():
        links = _by_representatives(large, texts, width, percent)
        parts = connected_components(links).select(F.col("v").alias("doc"), F.col("c").alias("part"))
        links = parts.select(F.col("part").alias("a"), F.col("doc").alias("b"))
        parted = skew_join(weighed, parts, "doc").select("c", "doc", "n", F.coalesce("part", "doc").alias("part"))
    dealt = _table(_block_pairs(_table(parted.select("c", "part", "doc", "n")), "c", block // 2, block_shingles))
    of_texts = texts.join(bounded_broadcast(dealt), "doc").select("c", "p", "q", "doc", "text")
    edges = of_texts.repartition("c", "p", "q").sortWithinPartitions("c", "p", "q").mapInArrow(_linked(width, percent), "a long, b long")
    labels = connected_components(edges if links is None else edges.unionByName(links))

    named = classes.select("set_hash", F.col("doc_id").alias("v")).join(labels, "v", "left").select("set_hash", F.coalesce("c", "v").alias("c"))
    out = skew_join(signed, named, "set_hash")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _enough(pairs: DataFrame, probes: DataFrame, min_matches: int, percent: int) -> DataFrame:
    """Pairs that agree in enough coordinates and whose set sizes allow the similarity."""

    def run(batches):
        for b in batches:
            x, y = (_matrix(b.column(i), np.uint8) for i in (2, 3))
            keep = pa.array((x == y).sum(axis=1) >= min_matches)
            yield pa.record_batch([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    of_a, of_b = (probes.select(F.col("doc").alias(k), F.col("n").alias(f"n{k}"), F.col("probe").alias(f"s{k}")) for k in "ab")
    both = skew_join(skew_join(pairs, of_b, "b", "inner"), of_a, "a", "inner").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir), width=2, percent=80)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8.

    A document without words is alone in its group; a null doc_id is never a duplicate.
    """
    found = near_components(docs, width=5, percent=80)
    gone = found.where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


#: The same rows by comparing all documents that share a shingle; for small tables.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 80 * (x.n + y.n - inter)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b),
c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
