"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from pitchframe.llm.byte_bpe import op4_byte_bpe
from pitchframe.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from pitchframe.llm.line_dedup import OP5_SQL, op5_line_dedup
from pitchframe.llm.media_columns import op9_media_columns
from pitchframe.llm.merkle import OP12_SQL, op12_merkle
from pitchframe.llm.ngram_jaccard import op1_ngram_jaccard
from pitchframe.llm.packing import op11_packing
from pitchframe.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from pitchframe.llm.secret_scan import op7_secret_scan
from pitchframe.llm.source_mixing import OP10_SQL, op10_source_mixing
from pitchframe.llm.token_counts import op6_token_counts
from pitchframe.llm.toxicity import op2_toxicity
from pitchframe.llm.warc_derivatives import OP8_SQL, op8_warc_derivatives

QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_toxicity": op2_toxicity,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_secret_scan": op7_secret_scan,
    "op8_warc_derivatives": op8_warc_derivatives,
    "op9_media_columns": op9_media_columns,
    "op10_source_mixing": op10_source_mixing,
    "op11_packing": op11_packing,
    "op12_merkle": op12_merkle,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL = {
    "op3_exact_dedup": OP3_SQL,
    "op5_line_dedup": OP5_SQL,
    "op8_warc_derivatives": OP8_SQL,
    "op10_source_mixing": OP10_SQL,
    "op12_merkle": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
