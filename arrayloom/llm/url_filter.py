"""URL filters: rules first, then the likelihood ratio of two character models, of accepted and of rejected URLs.

Both are Markov models of variable order: the next character's probability after the longest context that was
seen, interpolated with those after all shorter ones (Witten-Bell: a context counts for less the more different characters
followed it), down to an even share of the alphabet.

P_k(x | c) = (n(cx) + t(c) P_k-1(x | c without its first character)) / (n(c) + t(c)), P_-1 = 1 / alphabet

n: counts, t(c): different characters after c. The score of a URL is the difference of its log2 probabilities, per character
(its end counts as one). A logistic curve fitted to URLs that the models haven't seen turns it into the probability of acceptance.

All URLs that rules decide are learnt from, but for those that calibrate. Spark labels and counts; nothing of a model is in one place. Distinct runs
of characters get their probabilities from a join a length, and go to the blocks of URLs that hold them, once a block.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_table, in_blocks, ship

ship(__name__)

#: Characters of URLs scored at a time, and different runs of characters counted at a time.
BLOCK_BYTES, BLOCK_RUNS = 250_000, 200_000
ORDER = 5
#: A share 1 / HELD_OUT of the labelled URLs, drawn by hash, isn't learnt from but calibrates the score, in steps of 1 / STEPS.
HELD_OUT, STEPS = 4, 100
#: Text begins and ends with these.
BEGIN, END = "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    """Holds for the host and all its subdomains, for paths that start with path."""

    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("org", "/", True),
    Rule("example.org", "/es/", False),
    Rule("example.org", "/en/1", False),
    Rule("com", "/fr/", True),
    Rule("com", "/de/", False),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path; both are empty where the URL is null or has no ://."""
    place = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(place > 0, F.substr(url, place + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(name, allow) of the longest rule that fits, null if none does; of rules as long as each other the first wins."""
    out = F.lit(None).cast("struct<name:string,allow:boolean>")
    for r in sorted(rules, key=lambda r: -len(r.name))[::-1]:
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.allow).alias("allow"))).otherwise(out)
    return out


# ---- models ----------------------------------------------------------------------------------


def _sample(urls: DataFrame, most: int, chars: int) -> DataFrame:
    """The first `most` URLs in order of their hash, until they have `chars` characters."""
    first = urls.orderBy(F.xxhash64("url", F.lit(1)), "url").limit(most)
    # at most `most` rows are left for this window
    return first.withColumn("until", F.sum(F.char_length("url") + 1).over(Window.orderBy(F.xxhash64("url", F.lit(1)), "url"))).where(F.col("until") <= chars).select("allow", "url")


def windows(url: str | None, order: int) -> list[str]:
    """Each character of a URL and its end, with the order characters before it, or fewer where there are fewer."""
    s = BEGIN + (url or "") + END
    return [s[max(0, i - order) : i + 1] for i in range(1, len(s))]


def _in_chunks(batches):
    """Rows, whose second column is a URL, with the number of their block."""
    part = TaskContext.get().partitionId() << 32
    for k, b in enumerate(in_blocks(batches, BLOCK_BYTES)):
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part + k))], names=[*b.schema.names, "chunk"])


def _held_runs(order: int):
    """(chunk, url) -> (chunk, gram): each window of a block once, or a few times where batches cut it."""

    def run(batches):
        for b in batches:
            found = {}
            for c, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.setdefault(c, set()).update(windows(u, order))
            for c, grams in found.items():
                yield pa.record_batch([pa.array(np.full(len(grams), c)), pa.array(list(grams), pa.string())], names=["chunk", "gram"])

    return run


def _counted_runs(order: int):
    """(allow, url) -> (gram, a, r): occurrences of windows in accepted and rejected URLs, summed by block."""

    def told(counts):
        return [pa.record_batch([pa.array(n.keys(), pa.string()), *(pa.array(n.values() if x == which else [0] * len(n), pa.int64()) for x in (True, False))], names=["gram", "a", "r"]) for which, n in counts.items()]

    def run(batches):
        counts = {True: Counter(), False: Counter()}
        for b in batches:
            for allow, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[allow].update(windows(u, order))
                if len(counts[allow]) > BLOCK_RUNS:
                    yield from told(counts)
                    counts = {True: Counter(), False: Counter()}
        yield from told(counts)

    return run


def run_scores(examples: DataFrame, wanted: DataFrame, order: int = ORDER) -> DataFrame:
    """examples(allow, url), wanted(gram) -> (gram, score): log2 P(accepted) - log2 P(rejected) of the last character of each wanted window.

    A window's probability follows from the window without its first character, so all are computed from the shortest to the
    longest, a join a length. A run stands in at most as many longer ones as there are characters, so no key is hot.
    """
    counts = examples.select("allow", "url").mapInArrow(_counted_runs(order), "gram string, a long, r long")
    found = counts.unionByName(wanted.select("gram", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("r"))).groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    size = F.char_length("gram")
    ends = F.transform(F.sequence(F.lit(1), size), lambda k: F.substr("gram", size - k + 1, k))
    runs, _ = as_table(found.select(F.explode(ends).alias("gram"), "a", "r").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r")))
    context = F.substr("gram", F.lit(1), size - 1).alias("context")
    both = runs.withColumn("context", context)
    of = runs.groupBy(context).agg(*(f(x) for x in "ar" for f in (lambda x: F.sum(x).alias(f"n{x}"), lambda x: F.count_if(F.col(x) > 0).alias(f"t{x}"))))
    both, _ = as_table(both.join(of, "context").withColumn("size", size))
    alphabet = runs.where((size == 1) & (F.col("a") + F.col("r") > 0)).count() + 1

    def probability(x, before):
        n, t = F.col(f"n{x}"), F.col(f"t{x}")
        return F.when(n > 0, (F.col(x) + t * before) / (n + t)).otherwise(before).alias(f"p{x}")

    out = level = None
    for k in range(order + 1):
        rows = both.where(F.col("size") == k + 1)
        if level is None:
            level = rows.select("gram", *(probability(x, F.lit(1.0 / alphabet)) for x in "ar"))
        else:
            shorter = level.select(F.col("gram").alias("end"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
            level = rows.withColumn("end", F.substr("gram", F.lit(2), F.lit(k))).join(shorter, "end").select("gram", *(probability(x, F.col(f"q{x}")) for x in "ar"))
        level, _ = as_table(level)
        out = level if out is None else out.unionByName(level)
    return out.select("gram", (F.log2("pa") - F.log2("pr")).alias("score"))


def _score_chunks(order: int):
    """Rows of a block, whose second column is a URL, and the scores of the block's windows: the rows with their score."""

    def run(rows: pa.Table, scores: pa.Table) -> pa.Table:
        of = dict(zip(scores.column("gram").to_pylist(), scores.column("score").to_pylist(), strict=True))
        out = []
        for u in rows.column(1).to_pylist():
            each = [of[w] for w in windows(u, order)]
            out.append(sum(each) / len(each))
        return rows.drop_columns("chunk").append_column("score", pa.array(out, pa.float64()))

    return run


def logistic(score: np.ndarray, accepted: np.ndarray, rejected: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps, from counts by score. Both verdicts weigh alike; (1, 0) if one is absent or they can't be told apart."""
    if not accepted.sum() or not rejected.sum():
        return 1.0, 0.0
    # a target of less than certainty keeps the curve finite where a score parts the verdicts
    up, down = (accepted.sum() + 1) / (accepted.sum() + 2), 1 / (rejected.sum() + 2)
    x = np.stack([score, np.ones(len(score))], axis=1)
    wa, wr = accepted / accepted.sum(), rejected / rejected.sum()
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (wa * (p - up) + wr * (p - down)) + 1e-6 * beta
        hessian = (x * ((wa + wr) * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        step /= max(1.0, np.abs(step).max() / 5)
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)


def scored(rows: DataFrame, order: int = ORDER, max_examples: int | None = None, max_chars: int | None = None) -> tuple[DataFrame, float, float]:
    """Rows, whose second column is a URL and whose allow says what a rule decided, with their score, per character; slope and shift of the curve.

    All labelled URLs that aren't held out are learnt from, unless max_examples or max_chars bound those of each verdict; repeated
    URLs count once. The curve is of all held-out URLs: acceptance is 1 / (1 + exp(-(slope * score + shift))).
    """
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    rows, _ = as_table(rows.mapInArrow(_in_chunks, f"{types}, chunk long"))
    held = F.pmod(F.xxhash64("url", F.lit(2)), F.lit(HELD_OUT)) == 0
    known = lambda df, *more: df.where("allow IS NOT NULL").select("allow", F.coalesce("url", F.lit("")).alias("url"), *more).distinct()
    examples = known(rows).where(~held)
    if max_examples is not None or max_chars is not None:
        bounds = 2**31 - 1 if max_examples is None else max_examples, 2**62 if max_chars is None else max_chars
        examples = _sample(examples.where("allow"), *bounds).union(_sample(examples.where("NOT allow"), *bounds))
    wanted, _ = as_table(rows.select("chunk", "url").mapInArrow(_held_runs(order), "chunk long, gram string"))
    scores = wanted.join(run_scores(examples, wanted, order), "gram").select("chunk", "gram", "score")
    out, _ = as_table(rows.groupBy("chunk").cogroup(scores.groupBy("chunk")).applyInArrow(_score_chunks(order), f"{types}, score double"))
    # a score lies between plus and minus 60 or so, so bins are few
    bins = known(out, "score").where(held).groupBy(F.round(F.col("score") * STEPS).cast("long").alias("bin"))
    bins = bins.agg(F.count_if("allow").alias("accepted"), F.count_if(~F.col("allow")).alias("rejected")).orderBy("bin").toArrow()
    return out, *logistic(bins["bin"].to_numpy() / STEPS, bins["accepted"].to_numpy(), bins["rejected"].to_numpy())


def judge(pages: DataFrame, rules=RULES, **fit_options) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score, p_allow.

    A rule decides where one fits; elsewhere p_allow >= 0.5, from models of the URLs that rules decide. Without URLs of both verdicts
    to learn from, models know nothing of one side, and the sign of the score decides. Null URLs count as empty; repeated rows
    each return a row; other columns are ignored; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "url", "host", "path", F.col("found.name").alias("rule"), F.col("found.allow").alias("allow"))
    known, slope, shift = scored(rows, **fit_options)
    p = 1 / (1 + F.exp(-(F.lit(slope) * F.col("score") + F.lit(shift))))
    verdict = F.when(F.coalesce("allow", F.col("p_allow") >= 0.5), "allow").otherwise("block")
    return known.withColumn("p_allow", p).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", "p_allow")


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
