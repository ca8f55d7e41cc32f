"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from folioframe.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from folioframe.llm.fingerprints import op2_fingerprints
from folioframe.llm.language_id import op6_language_id
from folioframe.llm.line_dedup import OP10_SQL, op10_line_dedup
from folioframe.llm.ngram_join import op5_ngram_join
from folioframe.llm.packing import op7_packing
from folioframe.llm.quality import op8_quality
from folioframe.llm.url_filter import op4_url_filter
from folioframe.llm.sharding import op9_sharding
from folioframe.llm.source_mix import op3_source_mix

QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_fingerprints, op3_source_mix, op4_url_filter, op5_ngram_join, op6_language_id, op7_packing, op8_quality, op9_sharding, op10_line_dedup)}
ORACLES = {"op1_exact_dedup": OP1_SQL, "op10_line_dedup": OP10_SQL}
