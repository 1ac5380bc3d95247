"""The corpus operators' queries and their SQL, where SQL can express them."""

from lithospark.llm import bpe, langid, lexical, lines, manifest, ngram_join, packing, quality, repeats, rules, topk, toxicity, urls

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_langid": langid.op3_langid,
    "op4_bpe": bpe.op4_bpe,
    "op5_url_filter": urls.op5_url_filter,
    "op6_quality": quality.op6_quality,
    "op7_suffix_dedup": repeats.op7_suffix_dedup,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_quality_rules": rules.op9_quality_rules,
    "op10_topk": topk.op10_topk,
    "op11_lexical": lexical.op11_lexical,
    "op12_manifest": manifest.op12_manifest,
    "op13_toxicity": toxicity.op13_toxicity,
}
SQL = {**urls.SQL, **topk.SQL, **lexical.SQL, **manifest.SQL}
