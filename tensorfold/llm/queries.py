"""The corpus operators' queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .html_text import op3_html_text
from .lsh_search import op6_lsh_search
from .mixing import OP2_SQL, op2_mixing
from .multi_index import op8_multi_index
from .sentencepiece_codec import op1_sentencepiece
from .simhash import op4_simhash
from .token_files import op7_token_files
from .toxicity import op10_toxicity
from .url_filter import OP9_SQL, op9_url_filter
from .warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_mixing": op2_mixing,
    "op3_html_text": op3_html_text,
    "op4_simhash": op4_simhash,
    "op5_warc": op5_warc,
    "op6_lsh_search": op6_lsh_search,
    "op7_token_files": op7_token_files,
    "op8_multi_index": op8_multi_index,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {"op2_mixing": OP2_SQL, "op5_warc": OP5_SQL, "op9_url_filter": OP9_SQL}
