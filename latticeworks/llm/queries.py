"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from .balanced_shards import OP13_SQL, op13_balanced_shards
from .byte_bpe import op2_byte_bpe
from .decontamination import OP6_SQL, op6_benchmark_leaks
from .jaccard_join import op5_jaccard_join
from .media_tiff import op9_media_tiff
from .quality_lm import op3_quality_lm
from .ranked_search import OP12_SQL, op12_ranked_search
from .repeat_removal import OP1_SQL, op1_substring_dedup, op10_suffix_dedup
from .token_alignment import op11_token_alignment
from .token_shards import op7_token_shards
from .toxicity_crf import op8_toxicity_crf
from .warc_bundles import op4_warc_bundles

QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_byte_bpe, op3_quality_lm, op4_warc_bundles, op5_jaccard_join, op6_benchmark_leaks, op7_token_shards, op8_toxicity_crf, op9_media_tiff, op10_suffix_dedup, op11_token_alignment, op12_ranked_search, op13_balanced_shards)}
SQL = {"op1_substring_dedup": OP1_SQL, "op6_benchmark_leaks": OP6_SQL, "op12_ranked_search": OP12_SQL, "op13_balanced_shards": OP13_SQL}
