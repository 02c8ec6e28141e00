"""URL rules against plain Python, character models against dictionaries."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrayloom.llm import url_filter


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path


def rule(host, path, rules=url_filter.RULES):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


ODD = [None, "", "no scheme.org/es/1", "http://", "HTTP://A.ORG/", "x://Example.ORG/es/b?c#d", "https://u@a.b.example.org:80/en/1?x", "http://b.example.org/en/2", "a://b://c", "http://notexample.org/en/1/x", "http://com/fr/x"]
ODD += ["http://xcom/fr/x", "http://a.com/fr", "http://a.com/FR/", "http://É.com/de/é#ü?", "://org/", "http://a.org", "http://a.org?/es/", "http://a.org/\n/?x", "http://example.org/en/1", "http://a.net/" + "x/" * 50_000, "\x02\x03"]


def synthetic(n, seed=1):
    r = random.Random(seed)
    return [f"http{r.choice(['', 's'])}://{r.choice(['www.', 'm.', ''])}{''.join(r.choice('aeionrst') for _ in range(6))}.example.{r.choice(['org', 'com', 'net'])}/{r.choice(['en', 'fr', 'de', 'es'])}/{r.randrange(300)}" for _ in range(n)]


def pages(spark, urls):
    rows = [(k, u, "<p>", "clash", "clash", 1.5) for k, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, rule string, allow string, score double")


class Counts:
    """Witten-Bell over dictionaries, character by character."""

    def __init__(self, urls, order):
        self.order, self.n, self.after = order, Counter(), defaultdict(Counter)
        for u in urls:
            s = url_filter.BEGIN + u + url_filter.END
            for i in range(1, len(s)):
                for k in range(min(order, i) + 1):
                    self.after[s[i - k : i]][s[i]] += 1

    def log2(self, u, alphabet):
        s, total = url_filter.BEGIN + u + url_filter.END, 0.0
        for i in range(1, len(s)):
            p = 1 / alphabet
            for k in range(min(self.order, i) + 1):
                seen = self.after.get(s[i - k : i])
                if seen:
                    p = (seen[s[i]] + len(seen) * p) / (sum(seen.values()) + len(seen))
            total += math.log2(p)
        return total


@pytest.mark.parametrize("order", [0, 2, 5])
def test_judge(spark, order):
    urls = [*ODD, *ODD, *synthetic(300)]
    df = pages(spark, urls)
    got = {r.page_id: r for r in url_filter.judge(df, order=order).collect()}
    assert sorted(got) == list(range(len(urls)))
    held = {r.url for r in df.select("url").where(F.pmod(F.xxhash64("url", F.lit(2)), F.lit(url_filter.HELD_OUT)) == 0).collect()}
    learnt = {True: set(), False: set()}
    for u in {u for u in urls if u is not None}:
        r = rule(*parts(u))
        if r and u not in held:
            learnt[r.allow].add(u)
    models = [Counts(sorted(learnt[x]), order) for x in (True, False)]
    alphabet = len({c for x in learnt.values() for u in x for c in u + url_filter.END}) + 1
    for k, u in enumerate(urls):
        r = got[k]
        want = rule(*parts(u))
        assert (r.host, r.path, r.rule) == (*parts(u), want.name if want else None), u
        score = (models[0].log2(u or "", alphabet) - models[1].log2(u or "", alphabet)) / (len(u or "") + 1)
        assert r.score == pytest.approx(score, abs=1e-9)
        allowed = want.allow if want else r.p_allow >= 0.5
        assert r.verdict == ("allow" if allowed else "block")
    assert got[2].verdict in ("allow", "block") and got[2].rule is None


def test_all_labelled_urls_are_learnt(spark):
    """More URLs of one verdict, and more characters, than a bounded sample would hold."""
    urls = [f"http://{k}.org/{k * 7}" for k in range(23_000)] + [f"http://a.com/de/{k}/" + "xyz"[k % 3] * 25_000 for k in range(60)] + ["http://b.net/7"]
    df = pages(spark, urls)
    held = {r.url for r in df.select("url").where(F.pmod(F.xxhash64("url", F.lit(2)), F.lit(url_filter.HELD_OUT)) == 0).collect()}
    learnt = [[u for u in urls[:-1] if u not in held and (".org/" in u) == allow] for allow in (True, False)]
    assert len(learnt[0]) > 16_384 and sum(map(len, learnt[1])) > 1_000_000
    models = [Counts(x, 2) for x in learnt]
    alphabet = len({c for x in learnt for u in x for c in u + url_filter.END}) + 1
    got = {r.page_id: r.score for r in url_filter.judge(df, order=2).collect()}
    for k in (0, 1, 12_345, 23_000, 23_059, 23_060):
        want = (models[0].log2(urls[k], alphabet) - models[1].log2(urls[k], alphabet)) / (len(urls[k]) + 1)
        assert got[k] == pytest.approx(want, abs=1e-9)


def test_held_out_verdicts(spark):
    """The method agrees with rules on URLs that it hasn't learnt from."""
    urls = synthetic(3000, 7)
    df = pages(spark, urls)
    held = {r.url for r in df.select("url").where(F.pmod(F.xxhash64("url", F.lit(2)), F.lit(url_filter.HELD_OUT)) == 0).collect()}
    rows = [r for r in url_filter.judge(df).collect() if r.rule and urls[r.page_id] in held]
    agree = sum((r.p_allow >= 0.5) == (r.verdict == "allow") for r in rows) / len(rows)
    assert len(rows) > 200 and agree > 0.85


def test_nothing_to_learn_from(spark):
    assert url_filter.judge(pages(spark, [])).count() == 0
    got = url_filter.judge(pages(spark, [None, "http://a.net/", "http://b.org/"])).collect()
    assert [(r.host, r.path, r.rule) for r in got] == [("", "", None), ("a.net", "/", None), ("b.org", "/", "org/")]
    assert all(r.verdict in ("allow", "block") and 0 <= r.p_allow <= 1 for r in got)


def test_sample_is_bounded(spark):
    urls = synthetic(400)
    labelled = spark.createDataFrame([(u, k % 2 == 0) for k, u in enumerate(urls)], "url string, allow boolean")
    assert url_filter._sample(labelled, 50, 10**6).count() == 50
    few = url_filter._sample(labelled, 10**4, 1000)
    assert sum(len(r.url) + 1 for r in few.collect()) <= 1000 and few.count() > 10


def test_logistic():
    x = np.linspace(-3, 3, 61)
    p = 1 / (1 + np.exp(-(2 * x - 1)))
    slope, shift = url_filter.logistic(x, np.round(p * 1e6), np.round((1 - p) * 1e6))
    # both verdicts weigh alike: the shift moves by the logarithm of their shares
    odds = math.log(p.sum() / (1 - p).sum())
    assert slope == pytest.approx(2, rel=1e-3) and shift == pytest.approx(-1 - odds, rel=1e-2)
    assert url_filter.logistic(x, np.zeros(61), np.ones(61)) == (1.0, 0.0)
