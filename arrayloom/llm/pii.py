"""Personal data: fixed patterns, and terms that give a protected entity away.

Information-theoretic sanitisation: for every matched entity, the corpus is asked in how many documents
each term stands together with that entity and in how many it stands at all. From this,
P(entity | term) and the pointwise mutual information log2(P(entity | term) / P(entity)) tell how strongly
the term reveals the entity. A term over both disclosure thresholds is a span of its own wherever it
stands, also in documents without the entity, and is generalised when the text is sanitised.

Entities that stand in the same documents have the same figures, and so have terms; so both are put
into classes first, and pairs are pairs of classes. Entities that are too rare or too frequent for the
thresholds and terms too frequent for any entity beside them leave before pairs are formed.

DataFrame functions only. Word counts are summed before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, documents, let, skew_join, staged
from .spans import blanked, of_kind, pattern_spans, redacted, written

#: (?:\G|(?<!x)) keeps the matcher from trying every start in a long run of x; it loses no match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "term")

_IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
#: Terms are whole runs of two or more letters and digits.
_LETTER = r"\p{L}\p{M}\p{N}"
TERM = f"[{_LETTER}]{{2,}}"
#: Stands for the characters of entities, so that a run that touches one is known.
_FILL = "\uffff"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    total = let(F.split(F.reverse(digits), ""), lambda ds: F.aggregate(F.sequence(F.lit(0), F.size(ds) - 1), F.lit(0), lambda acc, i: acc + let(F.get(ds, i).cast("int") * (F.lit(1) + i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x))))
    return F.when(F.char_length(digits) > 0, total % 10 == 0).otherwise(F.lit(False))


def base_spans(text: Column) -> Column:
    """Entities by kind as listed, then start: array<struct<start, rank, end, kind, text>>."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,text:string,part:string>>")
    email = F.when(F.instr(text, "@") > 0, pattern_spans(text, EMAIL)).otherwise(none)
    ip = F.filter(pattern_spans(text, IP), lambda s: s["text"].rlike(_IP_PARTS))
    # only a long enough run of digits can be a card: no other match is looked at twice
    card = F.filter(pattern_spans(text, CARD), lambda s: F.when(F.char_length(s["text"]) >= 16, let(_digits(s["text"]), lambda x: F.char_length(x).between(16, 19) & luhn(x))).otherwise(F.lit(False)))
    phone = F.when(F.instr(text, "+") > 0, F.filter(pattern_spans(text, PHONE), lambda s: F.char_length(_digits(s["text"])).between(8, 15))).otherwise(none)
    found = F.concat(*(of_kind(x, k, KINDS[k]) for k, x in enumerate((email, F.when(text.rlike("[0-9]"), ip).otherwise(none), F.when(text.rlike("[0-9]"), card).otherwise(none), phone))))
    return found


def _free_words(text: Column, base: Column) -> Column:
    """Distinct lower-case terms that stand somewhere without touching an entity."""
    words = F.regexp_extract_all(blanked(text, F.sort_array(base), _FILL), F.lit(f"[{_LETTER}{_FILL}]{{2,}}"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(words, lambda w: ~F.contains(w, F.lit(_FILL))), F.lower))


def _signature(row: str) -> list[Column]:
    """Two words that tell sets of rows apart."""
    return [F.bit_xor(F.xxhash64(F.col(row), F.lit(seed))).alias(f"s{seed}") for seed in (1, 2)]


def disclosing_terms(docs: DataFrame, min_bits: float = 5.0, min_share: float = 0.5, min_documents: int = 2) -> DataFrame:
    """(term, bits): terms that disclose some entity, with the most bits they carry about one.

    A term discloses an entity if both stand in min_documents documents or more, if at least
    min_share of all documents with the term are among those, and if it carries min_bits bits about it.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(text.alias("text"))
    based = rows.select("text", base_spans(F.col("text")).alias("base")).where(F.size("base") > 0)
    entity = lambda e: F.concat_ws(":", e["kind"], F.when(e["rank"] == 0, F.lower(e["text"])).when(e["rank"] == 1, e["text"]).otherwise(_digits(e["text"])))
    found = staged(based.select(F.monotonically_increasing_id().alias("row"), F.array_distinct(F.transform("base", entity)).alias("entities"), _free_words(F.col("text"), F.col("base")).alias("words")))

    n_all = docs.count()  # one number
    entities = found.select("row", F.explode("entities").alias("entity"))
    # a share of at most 1 gives the bits only if the entity is rare enough
    known = entities.groupBy("entity").agg(F.count("*").alias("n_entity"), *_signature("row")).where((F.col("n_entity") >= min_documents) & (F.log2(F.lit(float(max(1, n_all))) / F.col("n_entity")) >= min_bits))
    sets = F.xxhash64("n_entity", "s1", "s2")
    live = staged(skew_join(entities, known.withColumn("e", sets).select("entity", "e", "n_entity"), "entity", "inner").select("row", "e", "n_entity").distinct())

    most = live.groupBy("row").agg(F.max("n_entity").alias("most"))
    words = skew_join(found.select("row", "words"), most, "row", "inner").select("row", "most", F.explode("words").alias("term"))
    counts = rows.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")).where(F.col("n_term") >= min_documents)
    rare = staged(skew_join(words, counts, "term", "inner").where(F.col("n_term") * min_share <= F.col("most")).select("row", "term", "n_term"))
    classed = rare.groupBy("term").agg(F.first("n_term").alias("n_term"), *_signature("row"))
    classes = staged(classed.select("term", "n_term", F.xxhash64("n_term", "s1", "s2").alias("t")))
    of_rows = skew_join(rare.select("row", "term"), classes.select("term", "t", "n_term"), "term", "inner").select("row", "t", "n_term").distinct()

    joint = of_rows.join(live, "row").where(F.col("n_term") * min_share <= F.col("n_entity")).groupBy("t", "e").agg(F.count("*").alias("n_both"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity"))
    share = F.col("n_both") / F.col("n_term")
    figures = joint.where(F.col("n_both") >= min_documents).withColumn("share", share).withColumn("bits", F.log2(F.col("share") * float(max(1, n_all)) / F.col("n_entity")))
    told = figures.where((F.col("share") >= min_share) & (F.col("bits") >= min_bits)).groupBy("t").agg(F.max("bits").alias("bits"))
    return classes.join(told, "t").select("term", "bits")


def find(docs: DataFrame, **thresholds) -> DataFrame:
    """One row per document: doc_id, text, base and spans (arrays), and disclosed (array of term, bits).

    Null text counts as empty and has no spans. Repeated rows each return a row and each count as
    a document; other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    terms = staged(disclosing_terms(docs, **thresholds))
    key = [F.col("doc_id"), F.xxhash64("text"), F.xxhash64(F.lit(3), "text")]
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))
    held = rows.select(F.struct(*key).alias("key"), F.explode(words).alias("term"))
    marks = held.join(bounded_broadcast(terms), "term").select("key", F.struct("term", "bits").alias("t"))
    marked = staged(marks.groupBy("key").agg(F.sort_array(F.collect_set("t")).alias("disclosed")))
    based = rows.select("doc_id", "text", F.struct(*key).alias("key"), base_spans(F.col("text")).alias("base"))
    return based.join(bounded_broadcast(marked), "key", "left").select("doc_id", "text", F.transform("base", lambda s: s.dropFields("text")).alias("base"), _with_terms(F.col("text"), F.col("base"), F.col("disclosed")).alias("spans"), "disclosed")


def _with_terms(text: Column, base: Column, disclosed: Column) -> Column:
    """The base spans and, after them, those of the disclosing terms that touch no entity."""
    own = F.transform(base, lambda s: s.dropFields("text"))

    def placed(parts: Column) -> Column:
        """parts: runs of other characters, each with the term that follows it."""
        terms = F.transform(disclosed, lambda t: t["term"])
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>").alias("out"))

        def step(acc: Column, p: Column) -> Column:
            end = acc["at"] + F.char_length(p)
            word = F.regexp_extract(p, f"[{_LETTER}]++$", 0)
            begin = end - F.char_length(word)
            hit = F.when(F.array_contains(terms, F.lower(word)), ~F.exists(base, lambda e: (e["start"] < end) & (begin < e["end"]))).otherwise(F.lit(False))
            span = F.struct(begin.cast("bigint").alias("start"), F.lit(4).alias("rank"), end.cast("bigint").alias("end"), F.lit("term").alias("kind"))
            return F.struct(end.cast("bigint").alias("at"), F.when(hit, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(parts, start, step, lambda acc: acc["out"])

    return F.when(F.size(F.coalesce(disclosed, F.array())) > 0, F.concat(own, let(F.regexp_extract_all(text, F.lit(f"[^{_LETTER}]*+[{_LETTER}]++"), F.lit(0)), placed))).otherwise(own)


def pii(docs: DataFrame, **thresholds) -> DataFrame:
    """One row per document: doc_id, the counts of the base kinds, base_sha256, spans, n_term."""
    number = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return find(docs, **thresholds).select(
        "doc_id",
        *(number(k).alias(f"n_{KINDS[k]}") for k in range(4)),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_term"),
    )


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """doc_id and the text with its spans replaced by their kinds: entities and disclosing terms."""
    return find(docs, **thresholds).select("doc_id", sanitised(F.col("text"), F.col("spans")).alias("text"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with its spans replaced by their kinds."""
    return redacted(text, F.sort_array(spans))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(documents(spark, sf_dir))


def _sql() -> str:
    from .secrets import _sql_spans

    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
    ip, card = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"[0-9](?:[\x20-]?[0-9])+"
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    double = "list_sum(list_transform(range(1, length(q) + 1), lambda i: CASE WHEN (length(q) - i) % 2 = 1 THEN (q[i]::INT * 2) // 10 + (q[i]::INT * 2) % 10 ELSE q[i]::INT END))"
    pieces = f"[^{_LETTER}]*[{_LETTER}]+"
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), "
        f"i AS ({_sql_spans('ip', 1, ip)}), k AS (SELECT *, {digits} AS q FROM ({_sql_spans('card', 2, card)})), f AS (SELECT * FROM ({_sql_spans('phone', 3, PHONE)}) WHERE length({digits}) BETWEEN 8 AND 15), "
        f"b0 AS ({_sql_spans('email', 0, email)} UNION ALL SELECT * FROM i WHERE len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(x AS BIGINT), 0) > 255)) = 0 "
        f"UNION ALL SELECT doc_id, start, rank, m, kind FROM k WHERE length(q) BETWEEN 16 AND 19 AND {double} % 10 = 0 UNION ALL SELECT * FROM f), "
        "b AS (SELECT *, start + length(m) AS stop, concat(kind, ':', CASE rank WHEN 0 THEN lower(m) WHEN 1 THEN m ELSE regexp_replace(m, '[^0-9]', '', 'g') END) AS e FROM b0), "
        # every word with its place; those without an entity on them
        f"p AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pieces}') AS l FROM d)), "
        f"w0 AS (SELECT doc_id, regexp_extract(x, '[{_LETTER}]+$') AS m, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM p), "
        "w AS (SELECT doc_id, lower(m) AS term, stop - length(m) AS start, stop FROM w0 WHERE length(m) > 1), "
        "free AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = w.doc_id AND b.start < w.stop AND w.start < b.stop)), "
        "n_t AS (SELECT term, count(DISTINCT doc_id) AS n_t FROM w GROUP BY term), n_e AS (SELECT e, count(DISTINCT doc_id) AS n_e FROM b GROUP BY e), "
        "j AS (SELECT e, term, count(*) AS n FROM (SELECT DISTINCT b.doc_id, e, term FROM b JOIN free USING (doc_id)) GROUP BY ALL HAVING count(*) >= 2), "
        "g AS (SELECT DISTINCT term FROM j JOIN n_e USING (e) JOIN n_t USING (term), (SELECT count(*) AS n_all FROM d) WHERE n / n_t >= 0.5 AND log2(n / n_t * n_all / n_e) >= 5.0), "
        "s AS (SELECT doc_id, rank, start, stop, kind FROM b UNION ALL SELECT doc_id, 4, start::BIGINT, stop::BIGINT, 'term' FROM free JOIN g USING (term)), "
        "a AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_email, count(*) FILTER (rank = 1) AS n_ip, count(*) FILTER (rank = 2) AS n_card, count(*) FILTER (rank = 3) AS n_phone, count(*) FILTER (rank = 4) AS n_term, "
        "coalesce(string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY rank, start) FILTER (rank < 4), '') AS base, string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY rank, start) AS spans FROM s GROUP BY doc_id) "
        "SELECT d.doc_id, " + ", ".join(f"coalesce(n_{x}, 0)::BIGINT AS n_{x}" for x in KINDS) + ", sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"
    )


SQL = _sql()
