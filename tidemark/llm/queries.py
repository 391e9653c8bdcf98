"""The queries of this subpackage, and their SQL where SQL can express them."""

from tidemark.llm import decontam, html_crf, langid, line_dedup, lm_scoring, mixing, prefix_trie, quality_pu, quality_rules, resampling, secrets, sharding, simhash
from tidemark.llm.common import table


def queries() -> dict:
    return {
        "op1_html_extraction": html_crf.op1,
        "op2_secret_scan": secrets.op2,
        "op3_line_dedup": line_dedup.op3,
        "op4_benchmark_decontamination": decontam.op4,
        "op5_quality_rules": quality_rules.op5,
        "op6_simhash_near_dedup": simhash.op6,
        "op7_sharding": sharding.op7,
        "op8_mixing": mixing.op8,
        "op9_quality_classifier": quality_pu.op9,
        "op10_language_id": langid.op10,
        "op11_importance_resampling": resampling.op11,
        "op12_prefix_trie": prefix_trie.op12,
        "op13_lm_scoring": lm_scoring.op13,
        # What two of the operators make of the documents.
        "redacted_documents": lambda spark, sf_dir: secrets.redacted(table(spark, sf_dir, "documents").select("doc_id", "text")),
        "cleaned_documents": lambda spark, sf_dir: quality_rules.cleaned(table(spark, sf_dir, "documents").select("doc_id", "text")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.OP3_SQL, "op5_quality_rules": quality_rules.OP5_SQL, "cleaned_documents": quality_rules.CLEANED_SQL, "op8_mixing": mixing.OP8_SQL, "op11_importance_resampling": resampling.OP11_SQL, "op12_prefix_trie": prefix_trie.OP12_SQL}
