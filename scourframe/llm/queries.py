"""The registered queries of this subpackage, and their equivalents in SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from scourframe.llm import bytebpe, descent, forest, language, minhash, negatives, packing, quotes, secrets, sharding, spelling, toxicity, wordpiece

REGISTRY = {
    "op1_quotation_linking": quotes.op1_quotation_linking,
    "op2_nn_descent": descent.op2_nn_descent,
    "op3_byte_bpe": bytebpe.op3_byte_bpe,
    "op4_token_counts": wordpiece.op4_token_counts,
    "op5_minhash_near_dedup": minhash.op5_minhash_near_dedup,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_lpt_sharding": sharding.op7_lpt_sharding,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_language_id": language.op9_language_id,
    "op10_projection_forest": forest.op10_projection_forest,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_secret_scan": secrets.op13_secret_scan,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {"op1_quotation_linking": quotes.OP1_SQL, "op12_hard_negatives": negatives.OP12_SQL}
