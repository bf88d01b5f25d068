"""The training-data queries and, where SQL can express them, their SQL."""

from . import decontaminate, exact, merkle, mixing, pii, quality, repeats, resample, secrets, simhash, tokens, toxicity, warc

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_simhash_near_duplicates": simhash.op2_simhash_near_duplicates,
    "op3_personal_data": pii.op3_personal_data,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_suffix_array_dedup": repeats.op5_suffix_array_dedup,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_warc": warc.op7_warc,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_token_ids": tokens.op10_token_ids,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_exact_dedup": exact.op12_exact_dedup,
    "op13_importance_resample": resample.op13_importance_resample,
}
ORACLES = {
    "op6_mix_sources": mixing.op6_sql(),
    "op7_warc": warc.op7_sql(),
    "op9_decontaminate": decontaminate.op9_sql(),
    "op11_merkle_manifest": merkle.op11_sql(),
    "op12_exact_dedup": exact.op12_sql(),
    "op13_importance_resample": resample.op13_sql(),
}
