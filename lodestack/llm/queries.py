"""The queries that this subpackage registers, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontamination, exact_dedup, jaccard_join, language_id, masked_lm, mixing, sharding, tokens, toxicity, warc

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_warc_fixity": warc.op2_warc_fixity,
    "op3_mixing": mixing.op3_mixing,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_masked_lm": masked_lm.op5_masked_lm,
    "op6_token_output": tokens.op6_token_output,
    "op7_language_id": language_id.op7_language_id,
    "op8_sharding": sharding.op8_sharding,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op9_jaccard_links": jaccard_join.op9_jaccard_links,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLES = {
    "op1_decontamination": decontamination.SQL,
    "op2_warc_fixity": warc.SQL,
    "op3_mixing": mixing.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op8_sharding": sharding.SQL,
    "op9_jaccard_join": jaccard_join.SQL,
    "op9_jaccard_links": jaccard_join.LINKS_SQL,
}
