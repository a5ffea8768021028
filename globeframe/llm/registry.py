"""The queries of this subpackage and their SQL."""

import corpus_pipeline

from . import chat_format, decontaminate, html_extract, language_id, near_duplicates, packing, suffix_dedup, token_counts, topk_search, toxicity

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_html_extract": html_extract.op5_html_extract,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_language_id": language_id.op7_language_id,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_topk_search": topk_search.op9_topk_search,
    "op10_near_duplicates": near_duplicates.op10_near_duplicates,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op2_suffix_dedup": suffix_dedup.oracle(),
    "op4_chat_format": chat_format.oracle(),
    "op8_decontaminate": decontaminate.oracle(),
    "op9_topk_search": topk_search.oracle(),
    "op10_near_duplicates": near_duplicates.oracle(),
}
