"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from riskloom.llm import op2_line_dedup, op4_decontaminate, op6_ngram_join, op7_warc, op9_chat, op12_substring_dedup, op13_collocations
from riskloom.llm.op1_toxicity import op1_toxicity
from riskloom.llm.op3_secrets import op3_secrets
from riskloom.llm.op5_packing import op5_packing
from riskloom.llm.op8_embedding_dedup import op8_embedding_dedup
from riskloom.llm.op10_pii import op10_pii
from riskloom.llm.op11_token_alignment import op11_token_alignment

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup.op2_line_dedup,
    "op3_secrets": op3_secrets,
    "op4_decontaminate": op4_decontaminate.op4_decontaminate,
    "op5_packing": op5_packing,
    "op6_ngram_join": op6_ngram_join.op6_ngram_join,
    "op7_warc": op7_warc.op7_warc,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_chat": op9_chat.op9_chat,
    "op10_pii": op10_pii,
    "op11_token_alignment": op11_token_alignment,
    "op12_substring_dedup": op12_substring_dedup.op12_substring_dedup,
    "op13_collocations": op13_collocations.op13_collocations,
}

ORACLE = {
    "op2_line_dedup": op2_line_dedup.SQL,
    "op6_ngram_join": op6_ngram_join.SQL,
    "op7_warc": op7_warc.SQL,
    "op9_chat": op9_chat.SQL,
    "op12_substring_dedup": op12_substring_dedup.SQL,
    "op13_collocations": op13_collocations.SQL,
}
