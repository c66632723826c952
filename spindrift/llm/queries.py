"""The corpus operators' registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontamination import op9_decontamination
from .html_extract import op4_html_extract
from .language_id import op2_language_id
from .license_scan import op10_license_scan
from .license_sql import OP10_SQL
from .packing import op7_packing
from .quality_knn import op6_quality_classifier
from .quality_rules import OP1_SQL, op1_quality_rules
from .sharding import op3_sharding
from .simhash import op8_simhash
from .toxicity import op5_toxicity

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_sharding": op3_sharding,
    "op4_html_extract": op4_html_extract,
    "op5_toxicity": op5_toxicity,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_packing": op7_packing,
    "op8_simhash": op8_simhash,
    "op9_decontamination": op9_decontamination,
    "op10_license_scan": op10_license_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": OP1_SQL,
    "op10_license_scan": OP10_SQL,
}
