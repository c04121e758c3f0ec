"""The queries of this subpackage and their SQL, for the driver's registry."""

from __future__ import annotations

from .simhash import op10_covering_simhash
from .token_orc import op1_token_orc
from .packing import op6_bounded_packing
from .exact_digest import op9_canonical_digest
from .langid import op3_rank_order_language
from .quality import op4_pairwise_quality
from .toxicity import op7_recurrent_toxicity
from .html_extract import op8_boosted_extraction
from .decontaminate import op5_spaced_seed_leaks
from .sharding import OP2_SQL, op2_jump_shards

QUERIES = {
    "op5_spaced_seed_leaks": op5_spaced_seed_leaks,
    "op8_boosted_extraction": op8_boosted_extraction,
    "op7_recurrent_toxicity": op7_recurrent_toxicity,
    "op3_rank_order_language": op3_rank_order_language,
    "op4_pairwise_quality": op4_pairwise_quality,
    "op9_canonical_digest": op9_canonical_digest,
    "op6_bounded_packing": op6_bounded_packing,
    "op1_token_orc": op1_token_orc,
    "op10_covering_simhash": op10_covering_simhash,
    "op2_jump_shards": op2_jump_shards,
}

ORACLES = {
    "op2_jump_shards": OP2_SQL,
}
