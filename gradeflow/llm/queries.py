"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, exact, jaccard, langid, licenses, periods, pieces, pii, resampling, secrets, substrings, toxicity


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": _pipeline,
        "op1_toxicity": toxicity.query,
        "op2_secret_scans": secrets.query,
        "op3_exact_dedup": exact.query,
        "op4_pii": pii.query,
        "op5_benchmark_decontamination": decontaminate.query,
        "op6_language_id": langid.query,
        "op7_license_scans": licenses.query,
        "op8_sentencepiece": pieces.query,
        "op9_ngram_jaccard_join": jaccard.query,
        "op10_substring_dedup": substrings.query,
        "op11_periodic_runs": periods.query,
        "op12_importance_resampling": resampling.query,
        "op13_chat_formatting": chat.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": exact.ORACLE,
        "op5_benchmark_decontamination": decontaminate.ORACLE,
        "op9_ngram_jaccard_join": jaccard.ORACLE,
        "op10_substring_dedup": substrings.ORACLE,
        "op12_importance_resampling": resampling.ORACLE,
        "op13_chat_formatting": chat.ORACLE,
    }
