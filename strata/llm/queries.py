"""The queries of this subpackage and the SQL that gives the same rows, where there is any."""

from __future__ import annotations

from strata.llm import bpe, html_extract, jaccard_join, jpeg, licenses, nbsvm, packing, quality_rules, toxicity, warc

QUERIES = {
    "op1_ngram_perplexity": quality_rules.op1,
    "op2_packing": packing.op2,
    "op3_warc_zstd": warc.op3,
    "op4_html_content": html_extract.op4,
    "op5_nbsvm": nbsvm.op5,
    "op6_toxicity": toxicity.op6,
    "op7_jpeg_thumbnails": jpeg.op7,
    "op8_jaccard_join": jaccard_join.op8,
    "op9_licenses": licenses.op9,
    "op10_bpe": bpe.op10,
}

ORACLE = {
    "op1_ngram_perplexity": quality_rules.ORACLE_SQL,
    "op3_warc_zstd": warc.ORACLE_SQL,
    "op6_toxicity": toxicity.ORACLE_SQL,
    "op8_jaccard_join": jaccard_join.ORACLE_SQL,
}
