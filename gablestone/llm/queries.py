"""Registered queries of the corpus operators, by name; SQL where SQL can say the same."""

from __future__ import annotations

from gablestone.llm.bpe import op6_bpe
from gablestone.llm.decontaminate import op3_decontaminate
from gablestone.llm.language_id import language_id_pages, op8_language_id
from gablestone.llm.licenses import op2_license_scan
from gablestone.llm.near_dups import op9_near_duplicates
from gablestone.llm.quality_classifier import op10_quality_classifier
from gablestone.llm.quality_rules import op1_quality_rules
from gablestone.llm.sharding import op5_sharding
from gablestone.llm.warc import OP7_SQL, op7_warc_audit
from gablestone.llm.wrappers import op4_html_extraction

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_license_scan": op2_license_scan,
    "op3_decontaminate": op3_decontaminate,
    "op4_html_extraction": op4_html_extraction,
    "op5_sharding": op5_sharding,
    "op6_bpe": op6_bpe,
    "op7_warc_audit": op7_warc_audit,
    "op8_language_id": op8_language_id,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_quality_classifier": op10_quality_classifier,
    "language_id_pages": language_id_pages,
}
ORACLE_SQL: dict[str, str] = {
    "op7_warc_audit": OP7_SQL,
}
