"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import mixing, preferences
from .ann import op6_ann_search
from .jaccard import op8_jaccard_join
from .media import op1_media_webp
from .mixing import op3_source_mixing
from .pii import op10_pii
from .preferences import op4_preference_format
from .quality import op5_quality_kneser_ney
from .sentencepiece_viterbi import op9_sentencepiece
from .substrings import op7_substring_dedup
from .warc import op2_warc_index

QUERIES = {
    "op1_media_webp": op1_media_webp,
    "op2_warc_index": op2_warc_index,
    "op3_source_mixing": op3_source_mixing,
    "op4_preference_format": op4_preference_format,
    "op5_quality_kneser_ney": op5_quality_kneser_ney,
    "op6_ann_search": op6_ann_search,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_pii": op10_pii,
}

SQL: dict[str, str] = {
    "op3_source_mixing": mixing.SQL,
    "op4_preference_format": preferences.SQL,
}
