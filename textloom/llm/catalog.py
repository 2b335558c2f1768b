"""The queries of this subpackage and the SQL that DuckDB checks them by."""

from __future__ import annotations

import corpus_pipeline
from textloom.llm import bpe, chat_tree, exact_dedup, langid, line_dedup, merkle, minhash, mixing, secrets, suffix_dedup, topk, vector_codes, warc


def queries() -> dict:
    return {
        "op1_minhash_near_dedup": minhash.op1_minhash_near_dedup,
        "op2_fuzzy_line_dedup": line_dedup.op2_fuzzy_line_dedup,
        "op3_chat_tree": chat_tree.op3_chat_tree,
        "op4_rake_mixing": mixing.op4_rake_mixing,
        "op5_warc": warc.op5_warc,
        "op6_secret_scan": secrets.op6_secret_scan,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_threshold_top_k": topk.op8_threshold_top_k,
        "op9_language_id": langid.op9_language_id,
        "op10_byte_bpe": bpe.op10_byte_bpe,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_suffix_dedup": suffix_dedup.op12_suffix_dedup,
        "op13_vector_codes": vector_codes.op13_vector_codes,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": minhash.OP1_SQL, "op3_chat_tree": chat_tree.OP3_SQL, "op5_warc": warc.OP5_SQL, "op7_exact_dedup": exact_dedup.OP7_SQL, "op8_threshold_top_k": topk.OP8_SQL, "op11_merkle_manifest": merkle.OP11_SQL, "op12_suffix_dedup": suffix_dedup.OP12_SQL, "op13_vector_codes": vector_codes.OP13_SQL}
