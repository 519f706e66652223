"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op10_bpe
from .decontamination import OP1_SQL, op1_decontamination
from .jaccard import OP9_SQL, op9_ngram_jaccard_join
from .language import op7_language_id
from .licenses import op3_license_scan
from .linededup import OP6_SQL, op6_line_dedup
from .quality_cnn import op8_quality_classifier
from .quality_rules import op2_quality_rules
from .sharding import op4_sharding
from .token_counts import op5_token_counts

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_rules": op2_quality_rules,
    "op3_license_scan": op3_license_scan,
    "op4_sharding": op4_sharding,
    "op5_token_counts": op5_token_counts,
    "op6_line_dedup": op6_line_dedup,
    "op7_language_id": op7_language_id,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_bpe": op10_bpe,
}

SQL: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op6_line_dedup": OP6_SQL,
    "op9_ngram_jaccard_join": OP9_SQL,
}
