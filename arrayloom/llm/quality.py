"""Line-first cleaning: rules on each line, then a verdict on the document by what is left.

DataFrame functions only, row by row: nothing is shuffled and no state outlives a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, WORD, documents, let, unused

#: Fixed phrases of footers, notices and banners, by language. A line with one of them, once lower-cased, is
#: boilerplate if it is short.
BOILERPLATE = (
    # English
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies", "enable javascript", "javascript is disabled", "click here", "subscribe to our", "sign up for our", "share this", "follow us on", "read more", "lorem ipsum",
    # licence notices, which are English in other languages' texts too
    "licensed under", "released under the", "creative commons", "copyright (c)", "©",
    # German
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "verwendet cookies", "hier klicken", "newsletter abonnieren", "mehr lesen", "folgen sie uns",
    # French
    "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "utilise des cookies", "cliquez ici", "lire la suite", "suivez-nous",
    # Spanish
    "todos los derechos reservados", "política de privacidad", "aviso legal", "condiciones de uso", "utiliza cookies", "haga clic", "leer más", "síguenos",
)
_PHRASES = "|".join(x.replace("(", r"\(").replace(")", r"\)") for x in BOILERPLATE)
#: What a sentence may end with, quotation marks and brackets after it included.
ENDS = ".!?:;…。！？\"'»”’)\\]"


def words_of(text: Column) -> Column:
    """Maximal runs of anything but the ASCII white space."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


#: A line without any of these has no navigation bars, symbols or shouts.
_ODD = r"[|»›·•/#*$%&<>{}\[\]\\^~=_]|::|!!"


def line_fails(line: Column, max_symbols: float = 0.1, max_shout: float = 0.5, min_sentence: int = 8) -> Column:
    """Whether a line is navigation, boilerplate, symbols, shouting or, with min_sentence words or more, without
    a sentence's end; blank lines don't fail. The dear looks at a line come last."""

    def judged(words: Column) -> Column:
        size = F.char_length(line) - count(line, r"[\x20\x09-\x0D]")
        symbols = count(line, r"[#*$%&|<>{}\[\]\\^~=_]") > size * max_symbols
        navigation = let(count(line, r"(?:^|(?<=[\x20\x09]))(?:[|»›·•/]|::|>>)(?=[\x20\x09]|$)"), lambda bars: (bars >= 3) & (bars * 4 >= words))
        shouting = let(count(line, r"!!+"), lambda n: (n >= 3) & (n >= words * max_shout))
        unended = (words >= min_sentence) & ~line.rlike(f"[{ENDS}]" + r"[\x20\x09-\x0D]*\z")
        boilerplate = (words > 0) & (words <= 20) & line.rlike("(?iu)" + _PHRASES)
        return unended | (line.rlike(_ODD) & (symbols | navigation | shouting)) | boilerplate

    return let(count(line, WORD), judged)


def _repeat_words(words: Column, window: int = 3) -> Column:
    """How many words stand in a window of three words that the text holds more than once."""

    def of(w: Column) -> Column:
        n = F.size(w)
        hashes = F.when(n >= window, F.transform(F.slice(w, 1, n - window + 1), lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, window))))).otherwise(F.array().cast("array<bigint>"))

        def counted(h: Column) -> Column:
            ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

            def places(s: Column) -> Column:
                again = F.filter(s, lambda x, i: x["h"].eqNullSafe(F.get(s, i - 1)["h"]) | x["h"].eqNullSafe(F.get(s, i + 1)["h"]))
                return F.sort_array(F.transform(again, lambda x: x["i"]))

            def covered(p: Column) -> Column:
                gaps = F.zip_with(F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), p, lambda b, a: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window)))
                return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)

            repeated = let(let(ordered, places), covered)
            return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(repeated)

        return let(hashes, counted)

    return let(words, of)


def assessed(text: Column, min_words: int = 50, max_repeat_percent: int = 50, min_kept: float = 0.5) -> Column:
    """A struct of the figures and verdicts on one text and the text without its failing lines."""
    dup = lambda parts: let(F.filter(parts, lambda x: x.rlike(WORD)), lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))
    cleaned = lambda parts: F.array_join(F.filter(parts, lambda x: ~line_fails(x)), "\n")
    by_line = let(F.split(text, "\n", -1), lambda parts: F.struct(dup(parts).alias("dup"), cleaned(parts).alias("cleaned")))
    figures = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("repeat")))

    def verdict(x: Column) -> Column:
        n, repeat, rest = x["f"]["n"], x["f"]["repeat"], x["l"]["cleaned"]
        failed = (n < min_words) | (100 * repeat > max_repeat_percent * n)
        left = F.when(rest == text, n).otherwise(count(rest, WORD))
        return F.struct(
            n.alias("n_words"),
            (F.char_length(text) - count(text, r"[\x20\x09-\x0D]")).cast("long").alias("word_chars"),
            count(text, r"[#*$%&|<>]").cast("long").alias("n_symbols"),
            x["l"]["dup"].alias("n_dup_lines"),
            repeat.alias("n_repeat_words"),
            failed.alias("base_failed"),
            (~failed & (left >= n * min_kept)).alias("kept"),
            rest.alias("cleaned"),
        )

    return let(F.struct(figures.alias("f"), by_line.alias("l")), verdict)


def quality(docs: DataFrame, **limits) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept and cleaned.

    base_failed: fewer than min_words words, or more than max_repeat_percent of the words in
    repeated three-word windows. kept: not base_failed, and line cleaning leaves at least min_kept of
    the words. Null, empty and blank texts fail. Repeated rows each return a row; other
    columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).select("doc_id", assessed(F.col("text"), **limits).alias("q")).select("doc_id", "q.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their failing lines. Columns stay as they are.

    Null and empty texts go. Repeated rows are judged each; an empty table gives no rows.

    The verdict is taken inside a generator: as a filter it would be pushed down and computed twice.
    """
    names = docs.columns
    rows = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    verdict = unused(docs, "verdict_")
    rows = rows.select("*", F.explode(F.filter(F.array(assessed(F.col("text"))), lambda q: q["kept"])).alias(verdict))
    new = {"text": F.col(f"{verdict}.cleaned"), "n_chars": F.char_length(F.col(f"{verdict}.cleaned")).cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in names])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t, " + _WORDS.format("coalesce(text, '')") + " AS w FROM documents), "
    "g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2), g2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g), "
    "r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g2, range(3) x(k) WHERE n > 1 GROUP BY doc_id), "
    "l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d), "
    r"f AS (SELECT doc_id, x, len(" + _WORDS.format("x") + r") AS w, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS size, "
    r"len(list_filter(regexp_split_to_array(x, '[\x20\x09]'), lambda y: y IN ('|', '»', '›', '·', '•', '/', '::', '>>'))) AS bars, "
    r"length(regexp_replace(x, '[^#*$%&|<>{}\[\]\\^~=_]', '', 'g')) AS symbols, len(regexp_extract_all(x, '!!+')) AS shouts, regexp_matches(x, '(?i)" + _PHRASES.replace("'", "''") + "') AS boiler, "
    "regexp_matches(x, '[" + ENDS.replace("'", "''") + r"][\x20\x09-\x0D]*$') AS ended FROM l), "
    "v AS (SELECT doc_id, x, w, (bars >= 3 AND bars * 4 >= w) OR symbols > size * 0.1 OR (shouts >= 3 AND shouts >= w * 0.5) OR (w <= 20 AND boiler) OR (w >= 8 AND NOT ended) AS fails FROM f), "
    "k AS (SELECT doc_id, coalesce(sum(w) FILTER (NOT fails), 0) AS left_words, count(*) FILTER (w > 0) - count(DISTINCT x) FILTER (w > 0) AS dup FROM v GROUP BY doc_id), "
    r"b AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, k.dup::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, k.left_words FROM d JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)), "
    "c AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b) "
    "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND left_words >= n_words * 0.5 AS kept FROM c"
)
