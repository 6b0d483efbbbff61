"""The operators' queries over whole tables, and SQL where it can express them."""

from __future__ import annotations

from .ann import op8_nearest_neighbours
from .chat_format import OP6_SQL, op6_chat_format
from .language_id import op7_language_id
from .line_dedup import OP13_SQL, op13_line_dedup
from .manifest import OP11_SQL, op11_merkle_manifest
from .merge_dropout import op9_merge_dropout
from .mixing import OP10_SQL, op10_mixing
from .ngram_join import op2_ngram_jaccard_join
from .pii import op1_pii
from .quantiles import op12_quantiles
from .quality_classifier import op3_quality_classifier
from .quality_rules import OP4_SQL, op4_quality_rules
from .url_filter import op5_url_filter

QUERIES = {f.__name__: f for f in (op1_pii, op2_ngram_jaccard_join, op3_quality_classifier, op4_quality_rules, op5_url_filter, op6_chat_format, op7_language_id, op8_nearest_neighbours, op9_merge_dropout, op10_mixing, op11_merkle_manifest, op12_quantiles, op13_line_dedup)}
SQL = {"op4_quality_rules": OP4_SQL, "op6_chat_format": OP6_SQL, "op10_mixing": OP10_SQL, "op11_merkle_manifest": OP11_SQL, "op13_line_dedup": OP13_SQL}
