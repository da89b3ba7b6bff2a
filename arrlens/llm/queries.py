"""The training-data queries, with DuckDB SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline

from . import chat_format, lexical_search, near_dedup
from .chat_format import op1_chat_format
from .decontaminate import op4_decontaminate
from .fingerprint import op10_fingerprint
from .html_extract import op7_html_extract
from .language_id import op11_language_id
from .lexical_search import op12_lexical_search
from .near_dedup import op8_near_dedup
from .packing import op5_packing
from .periodic_runs import op13_periodic_runs
from .quality import op6_quality
from .secret_scan import op3_secret_scan
from .sharding import op9_sharding
from .toxicity import op2_toxicity


def queries():
    ops = (op1_chat_format, op2_toxicity, op3_secret_scan, op4_decontaminate, op5_packing, op6_quality,
           op7_html_extract, op8_near_dedup, op9_sharding, op10_fingerprint, op11_language_id, op12_lexical_search, op13_periodic_runs)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    out = {"op1_chat_format": chat_format.ORACLE, "op8_near_dedup": near_dedup.ORACLE,
           "op12_lexical_search": lexical_search.ORACLE}
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
