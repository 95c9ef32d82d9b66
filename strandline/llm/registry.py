"""Queries over the text operators, and their SQL."""

from .chat_format import OP5_SQL, op5_chat_format
from .decontaminate import OP6_SQL, op6_decontaminate
from .language import op1_language
from .mixing import OP2_SQL, op2_mix_sources
from .neardup import OP10_SQL, op10_near_duplicates
from .quality import op9_quality
from .suffix_dedup import op7_suffix_dedup
from .toxicity import op4_toxicity
from .vectors import OP8_SQL, op8_nearest
from .warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_language": op1_language,
    "op2_mix_sources": op2_mix_sources,
    "op3_warc": op3_warc,
    "op4_toxicity": op4_toxicity,
    "op5_chat_format": op5_chat_format,
    "op6_decontaminate": op6_decontaminate,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_nearest": op8_nearest,
    "op9_quality": op9_quality,
    "op10_near_duplicates": op10_near_duplicates,
}
#: Tested against brute force or held-out rows instead: 1, 4, 7 and 9.
ORACLE_SQL = {
    "op2_mix_sources": OP2_SQL,
    "op3_warc": OP3_SQL,
    "op5_chat_format": OP5_SQL,
    "op6_decontaminate": OP6_SQL,
    "op8_nearest": OP8_SQL,
    "op10_near_duplicates": OP10_SQL,
}
