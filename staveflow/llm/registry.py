"""Queries of this subpackage and their SQL."""

from . import decontaminate, divergence, embedlsh, importance, linededup, lm, mixing, setjoin, shard, suffixdedup, toxicity, urlfilter, warc

QUERIES = {
    "op1_url_filter": urlfilter.op1_url_filter,
    "op2_winnowing": decontaminate.op2_winnowing,
    "op3_hypergeometric": shard.op3_hypergeometric,
    "op4_bloom_lm": lm.op4_bloom_lm,
    "op5_toxicity_cnn": toxicity.op5_toxicity_cnn,
    "op6_pstable_lsh": embedlsh.op6_pstable_lsh,
    "op7_suffix_dedup": suffixdedup.op7_suffix_dedup,
    "op8_pivotal_mix": mixing.op8_pivotal_mix,
    "op9_jaccard": setjoin.op9_jaccard,
    "op10_line_runs": linededup.op10_line_runs,
    "op11_divergence": divergence.op11_divergence,
    "op12_importance": importance.op12_importance,
    "op13_warc": warc.op13_warc,
}
ORACLES = {"op7_suffix_dedup": suffixdedup.SQL, "op9_jaccard": setjoin.SQL, "op2_winnowing": decontaminate.SQL, "op10_line_runs": linededup.SQL, "op11_divergence": divergence.SQL, "op12_importance": importance.SQL, "op13_warc": warc.SQL}
