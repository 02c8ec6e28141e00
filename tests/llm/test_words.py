"""Spelling variants and collocations against brute force."""

import collections
import random
import zlib

import numpy as np
import pytest
from tests_llm_tools import prose

from arrayloom.llm import collocations, spelling

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def lowered(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


# ---- spelling variants -------------------------------------------------------------------------


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(words, ratio=5):
    out = {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= ratio * n else None
        out[w] = (form, n, len(others), words[form] if form else None)
    rows = set()
    for w, (form, n, k, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, k, m))
    return rows


def many_words(seed, count):
    """Random words over few letters, with long runs of one letter, and edits of each other."""
    r, words = random.Random(seed), {}
    while len(words) < count:
        w = "".join(r.choice("abcé") for _ in range(r.randint(4, 9))) if r.random() < 0.5 or not words else list(r.choice(list(words)))
        if isinstance(w, list):
            i = r.randrange(len(w))
            w[i : i + r.randrange(2)] = r.choice(["", "a", "ÿ", "b"])
            w = "".join(w)
        if w:
            words[w] = 5 ** r.randrange(6) * r.randint(1, 3)
    words |= {"a" * k: 5 * k for k in range(1, 12)} | {"b" * 5000: 3, "b" * 5001: 90}
    return words


@pytest.mark.parametrize("most", [2, 40, 100_000])
def test_variants(spark, most):
    words = many_words(most, 250)
    df = spark.createDataFrame([(w, n, "clash") for w, n in words.items()], "word string, n long, size string")
    got = spelling.spelling_variants(df, most=most)
    assert {tuple(r) for r in got.collect()} == variants(words)
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]


def test_long_chains_of_forms(spark):
    words = {"abcdefg"[:k]: 5**k for k in range(1, 8)}
    got = spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {r.root for r in got.collect()} == {"abcdefg"}


def test_wavelet_tree():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 64, 1000):
        values = rng.permutation(n)
        left, low = rng.integers(0, n, 200), rng.integers(0, n, 200)
        right, high = left + rng.integers(0, n + 1, 200) % (n - left + 1), low + rng.integers(0, n + 1, 200) % (n - low + 1)
        q, v = spelling.WaveletTree(values).report(left, right, low, high)
        want = {(i, int(x)) for i in range(200) for x in values[left[i] : right[i]] if low[i] <= x < high[i]}
        assert len(q) == len(want) and set(zip(q.tolist(), v.tolist(), strict=True)) == want


def test_corpus_words(make, odd_rows):
    r = random.Random(5)
    rows = [*odd_rows, *((k, " ".join(r.choice(["Étrange", "ETRANGE", "naïveté×÷", "abcdef", "abcde", "x1longer-word_Next"]) for _ in range(40))) for k in range(100, 160))]
    counts = collections.Counter()
    for i, t in rows:
        run = ""
        for c in lowered(t) + " ":
            if c in LETTERS:
                run += c
                continue
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if run and h % 7 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
            run = ""
    got = spelling.corpus_words(make(rows), drop_every=7)
    assert {(x.word, x.n) for x in got.collect()} == {(w, n) for w, n in counts.items() if n >= 5} != set()


def test_no_words(make):
    for rows in ([], [(1, None), (None, "a b c")]):
        assert spelling.spelling_variants(spelling.corpus_words(make(rows))).count() == 0


# ---- collocations --------------------------------------------------------------------------------


def pieces(text):
    for c in ".,;:!?\n\x0b\x0c\r":
        text = text.replace(c, "\0")
    return [[w for w in p.replace("\t", " ").split(" ") if w] for p in lowered(text).split("\0")]


def ranked(rows, longest, least, top, percent):
    counts, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for p in pieces(text or ""):
            total[lang] += len(p)
            counts.update((lang, tuple(p[i : i + k])) for k in range(1, longest + 1) for i in range(len(p) - k + 1))
    candidates = {x: n for x, n in counts.items() if len(x[1]) > 1 and n >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in candidates.items():
        if any(lang == g and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * n >= percent * a for (g, q), n in candidates.items()):
            continue
        cuts = [(10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return {(lang, rank, p.decode(), -a, x, y, total[lang], -s) for lang, found in out.items() for rank, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)}


@pytest.mark.parametrize(("longest", "least", "bits", "top"), [(3, 3, 26, 2000), (3, 3, 3, 2000), (2, 2, 16, 7), (4, 2, 17, 50)])
def test_collocations(spark, make, odd_rows, longest, least, bits, top):
    """With few bits, buckets and bitmaps let nearly everything through; the rows are the same."""
    r = random.Random(bits)
    rows = [*odd_rows, *((k, " ".join(r.choice(["New York", "new york city", "a", "a a a", "b;", "É é", "x\ty\x1fz", "no\nway", "the", "of the"]) for _ in range(60))) for k in range(100, 140))]
    df = make(rows).repartition(3)
    langs = [(x.lang, x.text) for x in df.select("lang", "text").collect()]
    got = collocations.collocations(df, longest, least, top, bits=bits)
    assert {tuple(x) for x in got.collect()} == ranked(langs, longest, least, top, 50) != set()
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint")]


def test_scores_past_64_bits(spark):
    rows = [(99_999_999_999_999, 99_999_999_999_999, 99_999_999_999_999), (7_000_000_000_001, 80_000_000_000_003, 9_000_000_000_007), (10, 10**14 - 1, 10)]
    df = spark.createDataFrame(rows, "a long, l long, r long").select(collocations.score().alias("s"))
    assert [x.s for x in df.collect()] == [10**6 * a * a // (x * y) for a, x, y in rows]


def test_no_phrases(make):
    assert collocations.collocations(make([])).count() == 0
    assert collocations.collocations(make([(1, None), (2, "once only"), (3, prose(1, 1))])).count() == 0


def test_small_blocks_and_large_languages(make, monkeypatch):
    """Texts in several blocks and tasks give the counts of all."""
    rows = [(k, "alpha beta gamma, delta alpha beta") for k in range(50)]
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 40)
    got = {(r.lang, r.phrase): (r.a, r.n) for r in collocations.collocations(make(rows).repartition(4), bits=16).collect()}
    en = sum(k % 3 > 0 for k in range(50))
    # "alpha beta" is inside "alpha beta gamma" half the time
    assert got == {(g, p): (n, 6 * n) for g, n in (("en", en), ("und", 50 - en)) for p in ("alpha beta gamma", "delta alpha beta")}
