"""The operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from toplane.llm import decontaminate, jaccard, linededup, quality, suffix
from toplane.llm.bpe import op8_bpe
from toplane.llm.decontaminate import op7_decontaminate
from toplane.llm.jaccard import op10_jaccard_join
from toplane.llm.language import op4_language_id
from toplane.llm.linededup import op6_line_dedup
from toplane.llm.quality import op9_quality
from toplane.llm.secrets import op2_secrets
from toplane.llm.suffix import op3_suffix_dedup
from toplane.llm.token_counts import op1_token_counts
from toplane.llm.toxicity import op5_toxicity

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_secrets, op3_suffix_dedup, op4_language_id, op5_toxicity, op6_line_dedup, op7_decontaminate, op8_bpe, op9_quality, op10_jaccard_join)}
ORACLES = {
    "op3_suffix_dedup": suffix.ORACLE,
    "op6_line_dedup": linededup.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op9_quality": quality.ORACLE,
    "op10_jaccard_join": jaccard.ORACLE,
}
