"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, jaccard_join, near_dedup, ranked_search, warc
from .ann import op2_neighbours
from .bpe import op1_bpe
from .decontamination import op9_decontamination
from .html_text import op6_html_text
from .jaccard_join import op13_jaccard_join
from .language_id import op8_language_id
from .near_dedup import op10_near_dedup
from .quality import op3_quality
from .ranked_search import op11_ranked_search
from .token_alignment import op12_token_alignment
from .token_files import op5_token_files
from .url_filter import op4_url_filter
from .warc import op7_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_neighbours": op2_neighbours,
    "op3_quality": op3_quality,
    "op4_url_filter": op4_url_filter,
    "op5_token_files": op5_token_files,
    "op6_html_text": op6_html_text,
    "op7_warc": op7_warc,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_near_dedup": op10_near_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_token_alignment": op12_token_alignment,
    "op13_jaccard_join": op13_jaccard_join,
}
ORACLE_SQL: dict[str, str] = {
    "op7_warc": warc.ORACLE,
    "op9_decontamination": decontamination.ORACLE,
    "op10_near_dedup": near_dedup.ORACLE,
    "op11_ranked_search": ranked_search.ORACLE,
    "op13_jaccard_join": jaccard_join.ORACLE,
}
