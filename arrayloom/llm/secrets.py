"""Secret scans: fixed patterns, and strings whose windows have a high Shannon entropy.

DataFrame functions only, row by row. A candidate is a run of 20 or more token characters
with letters and digits. A window of 20 characters slides over it; counts by character change by the one
that enters and the one that leaves, and so does the sum of c*log2(c), which gives the entropy. The
threshold depends on the candidate's character class. An allow-list suppresses what isn't secret.

Candidates end at fixed patterns' matches and at words that mark a sample, as no window that
holds one of these counts. A candidate that isn't reported as a whole is looked at by its parts
between / and =, as paths and addresses join a secret with much else.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let, unused
from .spans import SPAN, blanked, of_kind, pattern_spans, redacted, written

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: {14,} and {16,} find what + and a filter on length would: a shorter run has no match in it.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
PART = r"[A-Za-z0-9+_-]{20,}"
WINDOW = 20
#: Least bits a character, of log2(20) = 4.32 at most, by class.
BITS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}
#: Not secrets: UUIDs, words joined by marks, paths and dates. Every part begins with a mark, so nothing is lost by
#: never giving one back (*+); a group that may give back recurses once a part, and long paths overflow the stack.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[A-Za-z]*(?:[-_/=+][A-Za-z]+|[-_/=+][0-9]{1,4})*+[-_/=+]*$",
)
#: Marks of a sample: no window that holds one counts, so candidates are cut there.
SAMPLE = r"(?i)example|placeholder|changeme|dummy|sample|x{6,}|0{8,}|1234567890"

_C_LOG_C = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def window_entropy(s: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits a character, of the string's windows; 0 if it is shorter."""
    table = F.array(*[F.lit(x) for x in _C_LOG_C])

    def of(codes: Column) -> Column:
        kinds = F.size(F.array_distinct(codes))
        places = let(F.array_distinct(codes), lambda d: F.transform(codes, lambda c: (F.array_position(d, c) - 1).cast("int")))

        def slide(p: Column) -> Column:
            zero = F.struct(F.array_repeat(F.lit(0), kinds).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

            def step(acc: Column, i: Column) -> Column:
                enters, leaves = F.get(p, i), F.get(p, i - window)
                out = F.when(i >= window, F.get(acc["counts"], leaves))
                s1 = acc["sum"] + F.when(i >= window, F.get(table, out - 1) - F.get(table, out)).otherwise(0.0)
                now = F.get(acc["counts"], enters) - F.when((i >= window) & (leaves == enters), 1).otherwise(0)
                s2 = s1 + F.get(table, now + 1) - F.get(table, now)
                counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == enters, 1).otherwise(0) - F.when((i >= window) & (k == leaves), 1).otherwise(0))
                entropy = F.when(i >= window - 1, F.lit(math.log2(window)) - s2 / window).otherwise(0.0)
                return F.struct(counts.alias("counts"), s2.alias("sum"), F.greatest(acc["best"], entropy).alias("best"))

            return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), zero, step, lambda acc: acc["best"])

        return let(places, slide)

    return F.when(F.char_length(s) >= window, let(F.split(s, ""), of)).otherwise(0.0)


def _high_entropy(s: Column) -> Column:
    mixed = s.rlike("[0-9]") & s.rlike("[A-Za-z]")
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | s.rlike(pattern)
    least = F.when(s.rlike("^[0-9A-Fa-f]+$"), BITS["hex"]).when(s.rlike("^[A-Za-z0-9]+$"), BITS["alnum"]).otherwise(BITS["base64"])
    return F.when(mixed & ~allowed, window_entropy(s) >= least).otherwise(F.lit(False))


def _in_parts(run: Column) -> Column:
    """The run if it is of high entropy, else its parts between / and = that are: spans like the run."""
    secret = lambda s: _high_entropy(s["text"])
    part = F.filter(pattern_spans(run["text"], PART), secret)
    placed = F.transform(part, lambda s: F.struct((run["start"] + s["start"]).alias("start"), (run["start"] + s["end"]).alias("end"), s["text"].alias("text"), s["part"].alias("part")))
    return F.when(secret(run), F.array(run)).when(run["text"].rlike("[/=]"), placed).otherwise(F.array().cast(SPAN))


def secret_spans(text: Column) -> Column:
    """struct(base, spans, n_assign, n_access, n_hex); spans are sorted by start, then kind."""
    assign = F.filter(pattern_spans(text, ASSIGN, 1), lambda s: F.char_length(s["part"]) >= 12)
    base = F.sort_array(F.concat(of_kind(assign, 0, "assign"), of_kind(pattern_spans(text, ACCESS), 1, "access"), of_kind(pattern_spans(text, HEX), 2, "hex")))

    def both(b: Column) -> Column:
        cut = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))
        cuts = F.sort_array(F.concat(F.transform(b, cut), F.transform(pattern_spans(text, SAMPLE), cut)))
        more = let(blanked(text, cuts), lambda rest: F.flatten(F.transform(pattern_spans(rest, CANDIDATE), _in_parts)))
        more = F.when(text.rlike(CANDIDATE), more).otherwise(F.array().cast(SPAN))
        number = lambda rank: F.size(F.filter(b, lambda s: s["rank"] == rank)).cast("long")
        return F.struct(b.alias("base"), F.sort_array(F.concat(b, of_kind(more, 3, "entropy"))).alias("spans"), number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"))

    return let(base, both)


def secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the counts of the base kinds, base_sha256, spans, n_entropy.

    Null text counts as empty and has no spans. Repeated rows each return a row; other columns
    are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select("doc_id", text.alias("text")).select("doc_id", secret_spans(F.col("text")).alias("f"))
    return found.select(
        "doc_id", "f.n_assign", "f.n_access", "f.n_hex", F.sha2(written(F.col("f.base")), 256).alias("base_sha256"), written(F.col("f.spans")).alias("spans"), (F.size("f.spans") - F.size("f.base")).cast("long").alias("n_entropy")
    )


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by their kind in brackets. Null text becomes empty; repeated rows
    are redacted each; other columns stay, whatever their names; an empty table gives no rows."""
    names = docs.columns
    rows = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    spans, new_text = unused(docs, "found_spans"), unused(docs, "new_text")
    rows = rows.withColumn(spans, secret_spans(F.col("text"))["spans"]).withColumn(new_text, redacted(F.col("text"), F.col(spans)))
    new = {"text": F.col(new_text), "n_chars": F.char_length(new_text).cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in names])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(documents(spark, sf_dir))


def _sql_spans(kind: str, rank: int, pattern: str, least: int = 0, group: int = 0) -> str:
    """Rows (doc_id, start, rank, stop, kind, m): lengths of the pieces between matches give the places."""
    p = pattern.replace("'", "''")
    return (
        f"SELECT doc_id, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start, {rank} AS rank, m[i] AS m, '{kind}' AS kind "
        f"FROM (SELECT doc_id, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS g, regexp_split_to_array(t, '{p}') AS p FROM d WHERE regexp_matches(t, '{p}'))) WHERE length(g[i]) >= {least}"
    )


#: The SQL engine's patterns never give back by themselves and don't know *+.
_ALLOWED = " OR ".join(f"regexp_matches(m, '{p.replace('*+', '*')}')" for p in ALLOW)


def _sql_islands(of: str, chars: str) -> str:
    """Runs of WINDOW characters or more in a row: doc_id, start, m."""
    return f"SELECT doc_id, min(pos) AS start, string_agg(ch, '' ORDER BY pos) AS m FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM {of} WHERE {chars}) GROUP BY doc_id, island HAVING count(*) >= {WINDOW}"


SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), "
    f"b AS ({_sql_spans('assign', 0, ASSIGN, 12, 1)} UNION ALL {_sql_spans('access', 1, ACCESS)} UNION ALL {_sql_spans('hex', 2, HEX)}), "
    f"cuts AS (SELECT doc_id, start, start + length(m) AS stop FROM b UNION ALL SELECT doc_id, start, start + length(m) FROM ({_sql_spans('sample', 9, SAMPLE)})), "
    f"chars0 AS (SELECT doc_id, unnest(range(start, start + length(m))) AS pos, unnest(string_split(m, '')) AS ch FROM ({_sql_spans('run', 9, CANDIDATE)})), "
    "chars AS (SELECT * FROM chars0 x WHERE NOT EXISTS (SELECT 1 FROM cuts WHERE cuts.doc_id = x.doc_id AND cuts.start <= x.pos AND x.pos < cuts.stop)), "
    f"c0 AS (SELECT *, false AS part FROM ({_sql_islands('chars', 'true')}) UNION ALL SELECT *, true FROM ({_sql_islands('chars', chr(39).join(['ch NOT IN (', '/', ', ', '=', ')']))})), "
    f"c AS (SELECT * FROM c0 WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT ({_ALLOWED})), "
    f"w AS (SELECT doc_id, start, part, m, unnest(range(1, length(m) - {WINDOW} + 2)) AS i FROM c), "
    f"h AS (SELECT doc_id, start, part, i, log2({WINDOW}.0) - sum(n * log2(n)) / {WINDOW} AS bits FROM (SELECT doc_id, start, part, i, ch, count(*) AS n FROM (SELECT doc_id, start, part, i, unnest(string_split(m[i:i + {WINDOW - 1}], '')) AS ch FROM w) GROUP BY ALL) GROUP BY ALL), "
    f"e0 AS (SELECT c.* FROM c JOIN (SELECT doc_id, start, part, max(bits) AS bits FROM h GROUP BY ALL) USING (doc_id, start, part) WHERE bits >= CASE WHEN regexp_matches(m, '^[0-9A-Fa-f]+$') THEN {BITS['hex']} WHEN regexp_matches(m, '^[A-Za-z0-9]+$') THEN {BITS['alnum']} ELSE {BITS['base64']} END), "
    "e AS (SELECT doc_id, start, 3 AS rank, m, 'entropy' AS kind FROM e0 x WHERE NOT part OR NOT EXISTS (SELECT 1 FROM e0 y WHERE NOT y.part AND y.doc_id = x.doc_id AND y.start <= x.start AND x.start < y.start + length(y.m))), "
    "s AS (SELECT *, concat(kind, ':', start, ':', start + length(m)) AS x FROM (SELECT * FROM b UNION ALL SELECT * FROM e)), "
    "a AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, count(*) FILTER (rank = 3) AS n_entropy, "
    "coalesce(string_agg(x, ',' ORDER BY start, rank) FILTER (rank < 3), '') AS base, string_agg(x, ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id) "
    "SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0)::BIGINT AS n_entropy FROM d LEFT JOIN a USING (doc_id)"
)
