"""Registered queries of the operators and of the pipeline, and their check SQL.

Only the divergence audit can be written in the check's SQL: tokenizers, XXH64, zstandard, learned models, CRC32 and
byte-level suffixes are not in it. The others are tested against brute force and exact round trips.
"""

from __future__ import annotations

from reviewlake.llm.op01_packing import op1_harmonic_packing
from reviewlake.llm.op02_language import op2_language_by_compression
from reviewlake.llm.op03_suffixes import op3_suffix_dedup
from reviewlake.llm.op04_quality import op4_pairwise_quality
from reviewlake.llm.op05_toxicity import op5_toxicity_automata
from reviewlake.llm.op06_elias_fano import op6_elias_fano_shards
from reviewlake.llm.op07_parsing import op7_locally_consistent_parsing
from reviewlake.llm.op08_bpe import op8_bpe_round_trip
from reviewlake.llm.op09_simhash import op9_covering_simhash
from reviewlake.llm.op10_repetition import op10_repetition_rules
from reviewlake.llm.op11_wrappers import op11_wrapper_extraction
from reviewlake.llm.op12_divergence import SQL as OP12_SQL
from reviewlake.llm.op12_divergence import op12_source_divergence
from reviewlake.llm.op13_conversations import op13_conversation_repair

QUERIES = {
    f.__name__: f
    for f in (
        op1_harmonic_packing,
        op2_language_by_compression,
        op3_suffix_dedup,
        op4_pairwise_quality,
        op5_toxicity_automata,
        op6_elias_fano_shards,
        op7_locally_consistent_parsing,
        op8_bpe_round_trip,
        op9_covering_simhash,
        op10_repetition_rules,
        op11_wrapper_extraction,
        op12_source_divergence,
        op13_conversation_repair,
    )
}

ORACLES: dict[str, str] = {"op12_source_divergence": OP12_SQL}
