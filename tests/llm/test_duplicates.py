import hashlib

import duckdb
import pytest
from tests_llm_tools import prose

from arrayloom.llm import exact_dedup, line_dedup, near_dedup


def lowered(t):
    return (t or "").encode().lower()


@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_groups(make, odd_rows, digest_all):
    got = exact_dedup.exact_dedup(make(odd_rows), digest_all=digest_all).toPandas()
    assert len(got) == len(odd_rows)
    groups = {}
    for i, t in odd_rows:
        groups.setdefault(lowered(t), []).append(i)
    for i, t in odd_rows:
        ids = groups[lowered(t)]
        keep = max((x for x in ids if x is not None), default=None)
        rows = got[got.doc_id == i] if i is not None else got[got.doc_id.isna()]
        if i is not None:
            r = rows.iloc[0]
            assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), keep == i)
            if digest_all:
                assert r.text_sha256 == hashlib.sha256(lowered(t)).hexdigest()


def test_exact_sql(make, odd_rows):
    rows = [(i, t) for i, t in dict(r for r in odd_rows if r[0] is not None).items()]
    got = exact_dedup.exact_dedup(make(rows)).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    documents = make(rows, extra=False).toPandas()
    con.register("documents", documents)
    want = con.sql(exact_dedup.SQL).df().sort_values("doc_id").reset_index(drop=True)
    assert (got[want.columns].astype(str) == want.astype(str)).all().all()


def components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = lowered(t).split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def near_rows():
    """A chain of edits, a large group of near copies of one text, a passage that many texts share."""
    rows, base = [], prose(5, 120, 3000).split()
    for k in range(120):
        w = list(base)
        for j in range(k % 12):
            w[(k * 7 + j * 11) % len(w)] = f"edit{k}x{j}"
        rows.append((1000 + k, " ".join(w)))
    passage = prose(9, 40, 3000)
    rows += [(2000 + k, passage + " " + prose(100 + k, 20 + k % 50, 3000)) for k in range(80)]
    chain = prose(11, 60, 3000).split()
    for k in range(25):
        chain = chain[2:] + [f"n{k}a", f"n{k}b"]
        rows.append((3000 + k, " ".join(chain)))
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_near_components(make, width):
    rows = near_rows()
    got = near_dedup.near_components(make(rows), width=width, block=32 if width == 2 else 1024).toPandas()
    want, sizes = components(rows, width, 80)
    assert dict(zip(got.doc_id, got.component_id, strict=True)) == want
    assert dict(zip(got.doc_id, got.n_shingles, strict=True)) == sizes
    assert (got.kept == (got.doc_id == got.component_id)).all()


def test_near_odd_rows(make, odd_rows):
    got = near_dedup.near_components(make(odd_rows), width=2).toPandas()
    assert len(got) == len(odd_rows)
    want, _ = components([(i, t) for i, t in odd_rows if i is not None], 2, 80)
    for r in got.itertuples():
        if r.doc_id == r.doc_id:
            assert r.component_id == want[r.doc_id], r
        else:
            assert not r.kept and r.component_id != r.component_id


def test_near_copies_cost_rows_in_proportion(make, spark):
    """Near copies of one text: rows that are dealt to compared blocks, and those sent to representatives."""
    base, sent = prose(5, 60, 3000).split(), {}
    from pyspark.sql import functions as F

    for m in (200, 800):
        rows = [(k, " ".join(w if j != k % 60 else f"e{k}" for j, w in enumerate(base))) for k in range(m)]
        df = make(rows)
        members = df.select(F.lit(0).alias("c"), F.col("doc_id").alias("doc"))
        texts = df.select(F.col("doc_id").alias("doc"), F.encode("text", "utf-8").alias("text"))
        links = near_dedup._by_representatives(members, texts, 2, 80)
        parts = near_dedup.connected_components(links).select(F.col("v").alias("doc"), F.col("c").alias("part"))
        dealt = near_dedup._block_pairs(members.join(parts, "doc").withColumn("n", F.lit(59)), "c", 32, 10**6)
        sent[m] = links.count(), dealt.count()
    assert sent[200][0] >= 199 and sent[800][0] <= 4.2 * sent[200][0] and sent[800][1] == 0


def test_near_blocks_of_groups_that_stay_apart(make, spark):
    """Pairs inside the largest part aren't dealt; every other pair meets in exactly one block pair at least."""
    rows = [(0, k % 3 if k % 5 else 7, k, 10) for k in range(60)]
    df = spark.createDataFrame(rows, "c long, part long, doc long, n long")
    got = near_dedup._block_pairs(df, "c", 8, 10**6).toPandas()
    part = {r[2]: r[1] for r in rows}
    met = set()
    for _, x in got.groupby(["p", "q"]):
        docs = sorted(x.doc)
        met |= {(a, b) for a in docs for b in docs if a < b}
    largest = max(set(part.values()), key=lambda p: (list(part.values()).count(p), p))
    assert {(a, b) for a in part for b in part if a < b and not part[a] == part[b] == largest} <= met


def test_near_repeated_ids_are_one_document(make):
    x, y = prose(1, 50, 3000), prose(2, 50, 3000)
    got = near_dedup.near_components(make([(5, x), (5, y), (7, x + " tail"), (9, y), (11, prose(3, 50, 3000))]), width=2).toPandas()
    assert sorted(zip(got.doc_id, got.component_id, strict=True)) == [(5, 5), (5, 5), (7, 5), (9, 5), (11, 11)]


def shared_tokens(make, rows):
    """Tokens of each text that another one has, too."""
    from pyspark.sql import functions as F

    docs = make(rows, extra=False).select("doc_id", F.encode("text", "utf-8").alias("text"))
    signed = docs.mapInArrow(near_dedup._sign(2), near_dedup._SIGNED)
    tokens = signed.select("doc_id", "sig").mapInArrow(near_dedup._post, "doc long, token long").toPandas()
    return tokens.token.duplicated(keep=False).groupby(tokens.doc).sum()


def test_near_texts_of_common_words_share_few_tokens(make):
    """What goes through the join doesn't rise with texts that are only of the same words; near copies still meet."""
    rows = [(k, prose(1000 + k, 200, 200)) for k in range(800)]
    assert shared_tokens(make, rows).sum() < len(rows)
    words = rows[0][1].split()
    copy = " ".join(w if k not in (30, 90, 150) else f"e{k}" for k, w in enumerate(words))
    assert (shared_tokens(make, [(1, rows[0][1]), (2, copy)]) >= 5).all()


def test_near_marked_texts(spark):
    """All rows of marked ids stay, whatever the bit that they fall on, and few others."""
    rows = spark.range(-2000, 2000).selectExpr("id * 1000003 AS doc", "encode(string(id), 'utf-8') AS text")
    docs = rows.where("doc % 8 = 0").select("doc")
    got = {r.doc: bytes(r.text).decode() for r in near_dedup._marked(rows, docs, 16).collect()}
    want = {k * 1000003 for k in range(-2000, 2000) if k % 8 == 0}
    assert want <= set(got) and len(got) < len(want) + 200 and all(int(t) * 1000003 == d for d, t in got.items())
    assert near_dedup._marked(rows, docs.where("false"), 16).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    """A chain of rising ids, whose vertices all hook onto their neighbours, and a star around its largest."""
    edges = [(k, k + 1) for k in range(40)] + [(100 + k, 999) for k in range(30)]
    got = near_dedup.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.v, r.c) for r in got.collect()} == {(k, 0) for k in range(41)} | {(100 + k, 100) for k in range(30)} | {(999, 100)}


def test_near_stage_keeps_one_of_each(make, spark):
    rows = near_rows()
    out = near_dedup.near_dedup_stage(spark, make(rows), "")
    want, _ = components(rows, 5, 80)
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted({c for c in want.values()})
    assert out.columns == make(rows).columns


def removed_lines(rows, least):
    lines = {i: [(k, x, len(x.encode().split())) for k, x in enumerate((t or "").split("\n")) if x.encode().split()] for i, t in rows}
    gone, order = {}, sorted(lines)
    for i in order:
        for j in range(len(lines[i])):
            for a in order:
                if a > i:
                    break
                for b in range(len(lines[a]) if a < i else j):
                    n = words = 0
                    while j + n < len(lines[i]) and b + n < len(lines[a]) and lines[i][j + n][1] == lines[a][b + n][1]:
                        words += lines[i][j + n][2]
                        n += 1
                    if words >= least:
                        gone.setdefault(i, set()).update(lines[i][j + q][0] for q in range(n))
    return gone


@pytest.mark.parametrize("least", [1, 7, 30, 50])
def test_line_runs(make, least):
    pieces = [prose(k, n) for k, n in enumerate([3, 10, 25, 60, 5, 18, 30, 2])]
    rows = []
    for k in range(14):
        order = [(k * 3 + j * (1 + k % 3)) % len(pieces) for j in range(9)]
        rows.append((k, "\n".join(pieces[j] if j % 4 or k % 2 else pieces[j] + "\n\n" + prose(50 + k, 9) for j in order)))
    got = line_dedup.line_dedup(make(rows), least).toPandas()
    want = removed_lines(rows, least)
    for r in got.itertuples():
        assert list(r.removed) == sorted(want.get(r.doc_id, ())), r.doc_id
    first = got[got.n_removed > 0].iloc[0]
    assert len(first.copied_from) and all(c <= first.doc_id for c in first.copied_from)


def test_line_odd_rows(make, odd_rows, spark):
    got = line_dedup.line_dedup(make(odd_rows)).toPandas()
    assert len(got) == len(odd_rows)
    by = got[got.doc_id.notna()].set_index("doc_id")
    assert (by.loc[5].n_removed > 0).all()  # the row without an id sorts first
    assert by.loc[12].n_removed == 0 and by.loc[1].text == "" and by.loc[3].text == " \n\t "
    out = line_dedup.line_dedup_stage(spark, make(odd_rows), "")
    assert out.columns == make(odd_rows).columns
    left = [r.doc_id for r in out.select("doc_id").collect()]
    assert 5 not in left and 6 not in left and 4 in left and 1 in left


@pytest.mark.parametrize("f", [exact_dedup.exact_dedup, near_dedup.near_components, line_dedup.line_dedup])
def test_empty_table(make, f):
    assert f(make([])).count() == 0
