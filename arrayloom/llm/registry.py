"""The corpus queries and the SQL that some of them can be compared with."""

from __future__ import annotations

from . import byte_bpe, collocations, exact_dedup, line_dedup, near_dedup, ngram_lm, packing, pii, quality, secrets, spelling, toxicity, url_filter

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_kneser_ney": ngram_lm.op2_kneser_ney,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_packing": packing.op6_packing,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_minhash": near_dedup.op9_minhash,
    "op10_pii": pii.op10_pii,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_url_filter": url_filter.op12_url_filter,
    "op13_collocations": collocations.op13_collocations,
}

ORACLES = {
    "op1_secret_scan": secrets.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op7_quality_rules": quality.SQL,
    "op9_minhash": near_dedup.SQL,
    "op10_pii": pii.SQL,
    "op11_spelling_variants": spelling.SQL,
    "op13_collocations": collocations.SQL,
}
