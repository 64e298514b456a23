"""The named queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from lapsekit.llm.conversations import op11_conversation_repair
from lapsekit.llm.decontaminate import OP10_SQL, op10_decontaminate
from lapsekit.llm.fingerprints import op7_fingerprints
from lapsekit.llm.jaccard_join import OP1_SQL, op1_jaccard_join
from lapsekit.llm.language import op6_language
from lapsekit.llm.lines import op8_line_dedup
from lapsekit.llm.manifest import op12_merkle_manifest
from lapsekit.llm.outliers import op13_quality_rules
from lapsekit.llm.packing import op4_packing
from lapsekit.llm.quality import op3_quality
from lapsekit.llm.substrings import op5_repeated_strings
from lapsekit.llm.token_store import op9_token_files
from lapsekit.llm.warc import op2_warc

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_jaccard_join": op1_jaccard_join,
    "op2_warc": op2_warc,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_repeated_strings": op5_repeated_strings,
    "op6_language": op6_language,
    "op7_fingerprints": op7_fingerprints,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_files": op9_token_files,
    "op10_decontaminate": op10_decontaminate,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_quality_rules": op13_quality_rules,
}
ORACLES: dict[str, str] = {"op1_jaccard_join": OP1_SQL, "op10_decontaminate": OP10_SQL}
