"""Queries of the training-data operators and their SQL, by name."""

from rasterloom.llm.chat import OP1_SQL, op1_chat_format
from rasterloom.llm.embedding_dedup import OP5_SQL, op5_embedding_dedup
from rasterloom.llm.html_layout import op10_html_extract
from rasterloom.llm.language import op9_language
from rasterloom.llm.packing import op7_packing
from rasterloom.llm.quality import op2_quality
from rasterloom.llm.sentencepiece_bpe import op6_sentencepiece
from rasterloom.llm.simhash import op4_simhash
from rasterloom.llm.topk import OP3_SQL, op3_topk
from rasterloom.llm.warc import op8_warc

QUERIES = {f.__name__: f for f in (op1_chat_format, op2_quality, op3_topk, op4_simhash, op5_embedding_dedup, op6_sentencepiece, op7_packing, op8_warc, op9_language, op10_html_extract)}
ORACLES = {"op1_chat_format": OP1_SQL, "op3_topk": OP3_SQL, "op5_embedding_dedup": OP5_SQL}
