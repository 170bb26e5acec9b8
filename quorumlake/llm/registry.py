"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from quorumlake.llm.bands import OP12_SQL, op12_near_prices
from quorumlake.llm.codebooks import OP13_SQL, op13_partial_distance_codes
from quorumlake.llm.decontamination import op1_latent_decontamination
from quorumlake.llm.fingerprints import op4_multiset_fingerprints
from quorumlake.llm.jaccard import OP8_SQL, op8_ngram_jaccard
from quorumlake.llm.language import op3_word_backoff_language
from quorumlake.llm.lines import OP5_SQL, op5_site_lines
from quorumlake.llm.packing import op7_bestfit_pack
from quorumlake.llm.pii import op6_disclosure_pii
from quorumlake.llm.quality import op11_fourier_quality
from quorumlake.llm.repeats import op10_suffix_repeats
from quorumlake.llm.scoring import OP2_SQL, op2_stupid_backoff
from quorumlake.llm.sharding import op9_jump_shards

QUERIES = {
    f.__name__: f
    for f in (
        op1_latent_decontamination, op2_stupid_backoff, op3_word_backoff_language, op4_multiset_fingerprints, op5_site_lines,
        op6_disclosure_pii, op7_bestfit_pack, op8_ngram_jaccard, op9_jump_shards, op10_suffix_repeats,
        op11_fourier_quality, op12_near_prices, op13_partial_distance_codes,
    )
}
SQL = {"op2_stupid_backoff": OP2_SQL, "op5_site_lines": OP5_SQL, "op8_ngram_jaccard": OP8_SQL, "op12_near_prices": OP12_SQL, "op13_partial_distance_codes": OP13_SQL}
