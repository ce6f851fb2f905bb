"""Operators of a training-data pipeline. Nothing outside this folder imports it, but for ``__spark_entry__``."""

from . import ann, langid, mixing, packing, pii, quality, simhash, toxicity, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_packing": packing.op2_packing,
    "op3_simhash": simhash.op3_simhash,
    "op4_ann": ann.op4_ann,
    "op5_line_cleaning": quality.op5_line_cleaning,
    "op6_mixing": mixing.op6_mixing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_pii": pii.op8_pii,
    "op9_language": langid.op9_language,
    "op10_warc": warc.op10_warc,
}

ORACLE_SQL = {"op1_url_filter": url_filter.OP1_SQL}
