"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import oracle
from .chat import op8_chat
from .codec import op13_bpe
from .decontaminate import op5_decontaminate
from .divergence import op11_divergence
from .language import op1_language
from .manifest import op12_manifest
from .packing import op10_packing
from .pii import op2_pii
from .quality_rules import op7_quality_rules
from .sharding import op4_sharding
from .simhash import op6_simhash
from .token_counts import op9_token_counts
from .toxicity import op3_toxicity

QUERIES = {
    "op1_language": op1_language,
    "op2_pii": op2_pii,
    "op3_toxicity": op3_toxicity,
    "op4_sharding": op4_sharding,
    "op5_decontaminate": op5_decontaminate,
    "op6_simhash": op6_simhash,
    "op7_quality_rules": op7_quality_rules,
    "op8_chat": op8_chat,
    "op9_token_counts": op9_token_counts,
    "op10_packing": op10_packing,
    "op11_divergence": op11_divergence,
    "op12_manifest": op12_manifest,
    "op13_bpe": op13_bpe,
}
ORACLE_SQL: dict[str, str] = {
    "op5_decontaminate": oracle.CONTAMINATION,
    "op7_quality_rules": oracle.QUALITY,
    "op11_divergence": oracle.DIVERGENCE,
    "op12_manifest": oracle.MANIFEST,
}
