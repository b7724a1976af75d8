"""Queries of the subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import sql
from .bpe import op7_bpe_encode_decode
from .decontaminate import op1_decontamination
from .html_main import op8_html_main_text
from .language_model import op6_language_model
from .license_scan import op9_license_scan
from .merge_replay import op12_merge_replay
from .phrases import op13_phrase_collocations
from .quality import op4_quality_rules
from .secret_scan import op10_secret_scan
from .simhash import op5_simhash_groups
from .substring import op2_substring_dedup
from .toxicity import op3_toxicity
from .vector_codes import op11_vector_codes

QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_substring_dedup,
        op3_toxicity,
        op4_quality_rules,
        op5_simhash_groups,
        op6_language_model,
        op7_bpe_encode_decode,
        op8_html_main_text,
        op9_license_scan,
        op10_secret_scan,
        op11_vector_codes,
        op12_merge_replay,
        op13_phrase_collocations,
    )
}

#: The models, fingerprints and parsers of the others SQL cannot express: tests/llm holds them against brute force.
ORACLE_SQL = {"op2_substring_dedup": sql.SUBSTRING_DEDUP, "op6_language_model": sql.LANGUAGE_MODEL, "op11_vector_codes": sql.VECTOR_CODES, "op13_phrase_collocations": sql.PHRASE_COLLOCATIONS}
