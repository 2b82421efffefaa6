"""Queries of the operators by name, and their DuckDB equivalents."""

from .chat_format import op9_chat_format
from .decontaminate import op2_decontaminate
from .language_id import op10_language_id
from .license_scan import op4_license_scan
from .ngram_join import op1_ngram_jaccard_join
from .private_data import op7_private_data
from .quality_model import op8_quality_classifier
from .quality_rules import op5_quality_rules
from .source_mix import op6_source_mix
from .url_reputation import OP3_SQL, op3_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_decontaminate,
        op3_url_filter,
        op4_license_scan,
        op5_quality_rules,
        op6_source_mix,
        op7_private_data,
        op8_quality_classifier,
        op9_chat_format,
        op10_language_id,
    )
}
ORACLE_SQL: dict[str, str] = {"op3_url_filter": OP3_SQL}
