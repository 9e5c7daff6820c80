"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat_format, url_filter, warc
from .bpe import op2_bpe
from .chat_format import op5_chat_format
from .decontaminate import op10_decontaminate
from .embedding_dedup import op1_embedding_dedup
from .minhash_dedup import op3_minhash_dedup
from .pii import op9_pii
from .quality import op8_quality
from .secret_scan import op4_secret_scan
from .url_filter import op6_url_filter
from .warc import op7_warc

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_bpe": op2_bpe,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_chat_format": op5_chat_format,
    "op6_url_filter": op6_url_filter,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_pii": op9_pii,
    "op10_decontaminate": op10_decontaminate,
}
SQL = {
    "op5_chat_format": chat_format.SQL,
    "op6_url_filter": url_filter.SQL,
    "op7_warc": warc.SQL,
}
