"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from .chroma import op9_chroma_fingerprints
from .collocations import OP12_SQL, op12_collocations
from .decontaminate import op1_decontaminate
from .divergence import OP11_SQL, op11_source_divergence
from .language_id import op2_language_id
from .language_model import op13_lm_scoring
from .licenses import op7_license_scan
from .mixing import OP3_SQL, op3_mix_sources
from .quality import op6_quality
from .simhash import op5_simhash_dedup
from .substring_dedup import op10_substring_dedup
from .token_files import op8_token_files
from .toxicity import op4_toxicity

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_language_id": op2_language_id,
    "op3_mix_sources": op3_mix_sources,
    "op4_toxicity": op4_toxicity,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_quality": op6_quality,
    "op7_license_scan": op7_license_scan,
    "op8_token_files": op8_token_files,
    "op9_chroma_fingerprints": op9_chroma_fingerprints,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_collocations": op12_collocations,
    "op13_lm_scoring": op13_lm_scoring,
}

ORACLE_SQL = {"op3_mix_sources": OP3_SQL, "op11_source_divergence": OP11_SQL, "op12_collocations": OP12_SQL}
