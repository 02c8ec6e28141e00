import base64
import collections
import hashlib
import math
import time
import zlib

import numpy as np
import pytest
from tests_llm_tools import prose

from arrayloom.llm import byte_bpe, ngram_lm, packing, toxicity


def test_bpe_is_the_librarys(make, odd_rows):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*odd_rows, (50, "aaaa aaaaa 'll don't <|endoftext|>  \n\n x"), (51, "ab" * 3000)]
    df = make([(i, t) for i, t in rows if i is not None])
    texts = {i: t or "" for i, t in rows if i is not None}
    for r in byte_bpe.round_trip(df, block_chars=500).collect():
        ids = coder.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    encoded = byte_bpe.encode(df)
    for r in byte_bpe.decode(encoded).collect():
        assert bytes(r.bytes).decode() == texts[r.doc_id]


def test_bpe_takes_an_earlier_rank_that_a_merge_makes_possible():
    """Ranks whose order isn't that of training: 'ab'+'c' ranks before 'ab' itself."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"abab": 258, b"bc": 259}
    import tiktoken

    coder = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    own = byte_bpe.MergeReplay(ranks, r"\S+|\s+")
    for text in ("abcabab", "abababc", "bcabcab", "aabbcc", "ababcababc", "cabab bcbc"):
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == coder.encode_ordinary(text)


def sequences(got):
    by = collections.defaultdict(list)
    for r in got.itertuples():
        by[r.sequence_id].append(r)
    return by


@pytest.mark.parametrize("limits", [{}, {"max_segments": 3}, {"max_tokens": 512, "max_loss": 300, "loss_col": "loss"}, {"max_tokens": 1000}])
def test_packing(make, odd_rows, limits):
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    rows = [(i, t) for i, t in dict(r for r in odd_rows if r[0] is not None).items()] + [(100 + k, prose(k, 5 + 37 * k % 900)) for k in range(60)]
    df = make(rows).withColumn("loss", F.when(F.col("doc_id") % 3 == 0, 40)).repartition(3)
    got = packing.pack(df, **limits).toPandas()
    whole = Tokenizer.from_file(packing.tokenizer_path("word_bpe_49k.json"))
    ids = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    most, segments, loss = limits.get("max_tokens", 2048), limits.get("max_segments", 64), limits.get("max_loss", 10**9)
    for i, parts in got.groupby("doc_id"):
        parts = parts.sort_values("start")
        assert parts.start.tolist() == [0, *np.cumsum(parts.length)[:-1]] and parts.length.sum() == len(ids[i])
        for r in parts.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[i][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[i])
    assert set(got.doc_id) == set(ids)
    for parts in sequences(got).values():
        parts.sort(key=lambda r: r.offset)
        total = sum(r.length for r in parts)
        assert [r.offset for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1]]
        assert total <= most and len(parts) <= segments and sum(r.loss_tokens for r in parts) <= loss
        assert total == most or total & (total - 1) == 0  # nothing is padded


def test_packing_limits_all_bind(make):
    """Of the sequences of many documents some are full, some have all their segments, some all their loss."""
    rows = [(k, prose(k, 900)) for k in range(12)] + [(100 + k, "a b") for k in range(900)] + [(2000 + k, prose(k, 40)) for k in range(60)]
    got = packing.pack(make(rows).coalesce(1), max_tokens=1024, max_segments=16, max_loss=800, prompt_share=1 / 8).toPandas()
    by = got.groupby("sequence_id").agg(tokens=("length", "sum"), segments=("length", "size"), loss=("loss_tokens", "sum"))
    assert (by.tokens <= 1024).all() and (by.segments <= 16).all() and (by.loss <= 800).all()
    assert (by.tokens == 1024).any() and (by.segments == 16).any() and (by.loss == 800).any()
    whole = got.groupby("doc_id").agg(loss=("loss_tokens", "sum"), tokens=("doc_tokens", "first"))
    assert (whole.loss == whole.tokens - whole.tokens // 8).all()


def test_packing_repeated_and_missing_ids(make, odd_rows):
    got = packing.pack(make(odd_rows)).toPandas()
    starts = got[got.start == 0].doc_id
    assert len(starts) == len(odd_rows) and starts.isna().sum() == sum(i is None for i, _ in odd_rows)


def kneser_ney(rows, training, order):
    """The same model over dictionaries."""
    end, start = "</s>", "<s>"
    tokens = {i: [*((t or "").encode().lower().split()), end] for i, t in rows}
    own = [tokens[i] for i in training]
    words = collections.Counter(w for t in own for w in t)
    count = {k: collections.Counter() for k in range(1, order + 1)}
    for t in own:
        t = [start, *t]
        for i in range(1, len(t)):
            for k in range(2, order + 1):
                if i - k + 1 >= 0 and (k == order or i - k + 1 == 0):
                    count[k][tuple(t[i - k + 1 : i + 1])] += 1
    for k in range(order, 1, -1):
        for g in list(count[k]):
            count[k - 1][g[1:]] += 1
    discounts = {k: ngram_lm._discounts([sum(v == n for v in c.values()) for n in range(1, 5)]) for k, c in count.items()}
    after = {k: collections.defaultdict(lambda: [0, 0, 0, 0]) for k in count}
    for k, c in count.items():
        for g, n in c.items():
            s = after[k][g[:-1]]
            s[0] += n
            s[min(n, 3)] += 1

    def p(context, w):
        out = 1 / (len(words) + 1)
        for k in range(1, len(context) + 2):
            c = tuple(context[len(context) - k + 1 :])
            if c in after[k]:
                n, s = count[k].get((*c, w), 0), after[k][c]
                out = (max(n - discounts[k][min(n, 3) - 1], 0) if n else 0) / s[0] + sum(a * b for a, b in zip(discounts[k], s[1:], strict=True)) / s[0] * out
        return out

    total, scores = sum(words.values()), {}
    for i, t in tokens.items():
        padded = [start, *t]
        model = sum(math.log10(p(padded[max(0, j - order + 1) : j], padded[j])) for j in range(1, len(padded)))
        scores[i] = (len(t), sum(w in words for w in t), sum(math.log10((words.get(w, 0) + 1) / (total + len(words) + 1)) for w in t), model)
    return scores, total, sum(p([b"the"], w) for w in [*words, "unseen"])


@pytest.mark.parametrize(("order", "shard"), [(2, 2000), (3, 2000), (4, 500), (3, 10**6)])
def test_language_model(make, odd_rows, order, shard):
    rows = [*odd_rows, *((100 + k, "The cat and the dog saw the " + prose(k, 60, 90)) for k in range(50)), (300, prose(3, 40, 90) + " never heard of")]
    rows = [(10**6 + k if i is None else i * 100 + k, t) for k, (i, t) in enumerate(rows)]  # repeated rows and those without an id count each
    training = [i for i, _ in rows if i % 4]
    df = make(rows)
    model = ngram_lm.fit(df.where("doc_id % 4 != 0").repartition(3), order=order, keys_a_shard=shard)
    got = ngram_lm.score(df, model).toPandas()
    want, total, mass = kneser_ney(rows, training, order)
    assert mass == pytest.approx(1.0) and len(got) == len(rows)
    for r in got.itertuples():
        n, known, base, own = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(own, rel=1e-9)


def test_language_model_takes_repeated_and_missing_ids(make, odd_rows):
    model = ngram_lm.fit(make(odd_rows))
    got = ngram_lm.score(make(odd_rows), model).toPandas()
    assert len(got) == len(odd_rows) and got.doc_id.isna().sum() == sum(i is None for i, _ in odd_rows)
    assert got[got.doc_id == 5].score.nunique() == 1


def test_tables_of_hashes(tmp_path):
    """Every key with its counts, small and large; no other key."""
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    for columns in (1, 4):
        values = rng.choice([1, 2, 3, 4, 254, 255, 256, 10**12], (len(keys), columns))
        ngram_lm.write_table(str(tmp_path), f"t{columns}", keys, values)
        table = ngram_lm.Table(str(tmp_path), f"t{columns}")
        assert (table.look_up(keys, columns) == values).all()
        assert not table.look_up(np.setdiff1d(rng.integers(0, 2**64, 5000, dtype=np.uint64), keys), columns).any()


def test_language_model_without_texts(make):
    model = ngram_lm.fit(make([]))
    got = ngram_lm.score(make([(1, "a b"), (2, None)]), model).toPandas()
    assert got.score.tolist() == [0.0, 0.0] and got.n_tokens.tolist() == [3, 1]


def toxic_rows():
    rows, labels = [], []
    for k in range(600):
        bad = k % 7 == 0
        words = prose(k, 80, 2500).split()
        if bad:
            for j in range(4):
                words[7 + 13 * j] = f"grump{'abcdef'[(k + j) % 6]}"
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return rows, labels


def test_toxicity(make, spark):
    rows, labels = toxic_rows()
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    index = toxicity.fit(make(rows), lab.where("doc_id % 3 != 1"))
    got = toxicity.score(make([*rows, (9000, None), (9001, "")]), index).toPandas()
    assert got.score.between(0, 1).all() and len(got) == 602
    held = got[(got.doc_id % 3 == 1) & (got.doc_id < 9000)].merge(lab.toPandas(), on="doc_id")
    assert (held[held.toxic == 1].predicted == 1).mean() > 0.95 and (held[held.toxic == 0].predicted == 0).mean() > 0.98
    assert (got[got.doc_id >= 9000].predicted == 0).all()
    assert all(e["toxic"] == 1 for r in held[held.predicted == 1].itertuples() for e in r.evidence[:1])


def test_toxicity_finds_a_copy_without_common_toxic_words(make, spark):
    """A labelled toxic text whose words stand in no other example is the neighbour of its copy."""
    rows, labels = toxic_rows()
    rows += [(7000, prose(7000, 60, 10**9)), (8000, prose(7000, 60, 10**9)), (8001, "quite unheard of")]
    lab = spark.createDataFrame([*labels, (7000, 1)], "doc_id long, toxic int")
    index = toxicity.fit(make(rows), lab)
    assert len(index.ids) == 601
    got = toxicity.score(make(rows), index).toPandas().set_index("doc_id")
    best = got.evidence[8000][0]
    assert (best["doc_id"], best["toxic"]) == (7000, 1) and best["cosine"] == pytest.approx(1.0)
    assert got.predicted[8000] == 1 and got.predicted[8001] == 0


def test_only_copies_of_one_label_are_dropped(make, spark):
    """A toxic variant of a clean text stays an example, and so does the clean one."""
    rows, labels = toxic_rows()
    clean = rows[1][1]
    rows += [(7000, clean + " vile"), (7001, clean)]
    index = toxicity.fit(make(rows), spark.createDataFrame([*labels, (7000, 1), (7001, 0)], "doc_id long, toxic int"))
    assert {1, 7000} <= set(index.ids) and 7001 not in index.ids


def test_neighbours_are_exact():
    """The index against all cosines."""
    rng = np.random.default_rng(3)
    terms = [b"t%d" % k for k in range(40)]
    probe = toxicity.ExampleIndex(terms, np.linspace(1, 3, 40), [], [], [])
    bags = [{terms[t]: int(rng.integers(1, 4)) for t in rng.choice(40, rng.integers(1, 8), replace=False)} for _ in range(500)]
    vectors = [probe.vector(b) for b in bags]
    index = toxicity.ExampleIndex(terms, probe.idf, vectors, [0] * 500, list(range(500)))
    for bag in bags[:60]:
        v = index.vector(bag)
        every = sorted(((sum(w * x.get(t, 0.0) for t, w in v.items()), -k) for k, x in enumerate(vectors)), reverse=True)
        want = [(s, -k) for s, k in every if s > 0][:15]
        got = index.nearest(v)
        assert [round(s, 9) for s, _ in got] == [round(s, 9) for s, _ in want]


def test_postings_are_added_at_once():
    """The same cosines as list by list, in clearly less time."""
    rng = np.random.default_rng(5)
    terms = [b"t%d" % k for k in range(5000)]
    vectors = [(np.sort(rng.choice(5000, 200, replace=False)).astype(np.int32), rng.random(200)) for _ in range(4000)]
    index = toxicity.ExampleIndex(terms, np.ones(5000), vectors, [0] * 4000, list(range(4000)))
    assert not len(index.matrix)

    def by_list(queries):
        out = np.zeros((len(queries), index.size))
        for x, (t, w) in zip(out, queries, strict=True):
            for a, b, y in zip(index.since[t].tolist(), index.since[t + 1].tolist(), w.tolist(), strict=True):
                x[index.example[a:b]] += y * index.weight[a:b]
        return out

    def least(f):
        times = []
        for _ in range(5):
            start = time.process_time()
            got = f(vectors[:64])
            times.append(time.process_time() - start)
        return min(times), got

    (slow, want), (fast, got) = least(by_list), least(index.cosines)
    assert np.allclose(got, want, atol=1e-12) and fast < 0.7 * slow


def test_numbered_terms_are_those_of_bags():
    """With beginnings, marks and terms that are there for their marks only, in ASCII and not."""
    texts = ["grumpy Grumpier grump é\u00e9\u00e9\u00e9\u00e9x x x x grumpy", "éééé éééééa éééééb lone lone", "", "lone", "grum gr grumble y y"]
    known = [b"grum-", b"grump-*2", "éééé-".encode(), "ééééé-*2".encode(), b"x*3", b"y", b"lone", b"lone*2", b"grumpy", b"absent"]
    number = {t: k for k, t in enumerate(known)}
    numbered = toxicity.Numbered(number)
    for text in [*texts, None, *texts]:
        raw = None if text is None else text.encode()
        want = sorted((number[t], n) for t, n in toxicity.Bags()(raw).items() if t in number)
        t, n = numbered(raw)
        assert list(zip(t.tolist(), n.tolist(), strict=True)) == want


def test_toxicity_without_labels(make, spark):
    index = toxicity.fit(make([(1, "a b c")]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(make([(1, "a b c"), (2, None)]), index).toPandas().score.between(0, 1).all()


@pytest.mark.parametrize("f", [byte_bpe.round_trip, packing.pack, byte_bpe.encode])
def test_empty_table(make, f):
    assert f(make([])).count() == 0
