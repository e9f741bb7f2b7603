"""Queries of this folder, by name."""

from __future__ import annotations

import corpus_pipeline
from rosterfold.llm.decontamination import op8_spaced_seed_leaks
from rosterfold.llm.fingerprints import op9_imatch_fingerprints
from rosterfold.llm.language_model import op2_log_bilinear_scores
from rosterfold.llm.main_text import op10_site_template_text
from rosterfold.llm.manifest import OP11_SQL, op11_incremental_witnesses
from rosterfold.llm.mixing import OP7_SQL, op7_hypergeometric_mix
from rosterfold.llm.ngram_join import op6_grouped_prefix_join
from rosterfold.llm.personal_data import op5_contextual_personal_data
from rosterfold.llm.phrases import OP13_SQL, op13_de_bruijn_phrases
from rosterfold.llm.quality import op3_quadratic_quality
from rosterfold.llm.secret_scan import op12_trigram_secrets
from rosterfold.llm.sharding import op1_minimax_shards
from rosterfold.llm.token_ids import op4_rans_token_ids

QUERIES = {f.__name__: f for f in (op1_minimax_shards, op2_log_bilinear_scores, op3_quadratic_quality, op4_rans_token_ids, op5_contextual_personal_data, op6_grouped_prefix_join, op7_hypergeometric_mix, op8_spaced_seed_leaks, op9_imatch_fingerprints, op10_site_template_text, op11_incremental_witnesses, op12_trigram_secrets, op13_de_bruijn_phrases)}
QUERIES["pipeline"] = corpus_pipeline.run

#: SQL for those that SQL can express.
ORACLE = {"op7_hypergeometric_mix": OP7_SQL, "op11_incremental_witnesses": OP11_SQL, "op13_de_bruijn_phrases": OP13_SQL}
