"""The queries of this subpackage, by name, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grovekit.llm.content_sort import OP11_SQL, op11_content_sort
from grovekit.llm.decontamination import OP10_SQL, op10_positional_decontamination
from grovekit.llm.jaccard_join import OP3_SQL, op3_ngram_jaccard_join
from grovekit.llm.language_model import op8_elias_fano_lm
from grovekit.llm.licenses import OP2_SQL, op2_license_minhash
from grovekit.llm.packing import op7_harmonic_packing
from grovekit.llm.prefix_trie import OP12_SQL, op12_conversation_prefix_trie
from grovekit.llm.sharding import op6_hypergeometric_sharding
from grovekit.llm.token_counts import op9_token_counts
from grovekit.llm.topk import OP4_SQL, op4_bit_sliced_topk
from grovekit.llm.toxicity import op5_toxicity_grammar
from grovekit.llm.warc import OP1_SQL, op1_warc_salvage
from grovekit.llm.whitening import op13_embedding_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc_salvage,
        op2_license_minhash,
        op3_ngram_jaccard_join,
        op4_bit_sliced_topk,
        op5_toxicity_grammar,
        op6_hypergeometric_sharding,
        op7_harmonic_packing,
        op8_elias_fano_lm,
        op9_token_counts,
        op10_positional_decontamination,
        op11_content_sort,
        op12_conversation_prefix_trie,
        op13_embedding_whitening,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_salvage": OP1_SQL,
    "op2_license_minhash": OP2_SQL,
    "op3_ngram_jaccard_join": OP3_SQL,
    "op4_bit_sliced_topk": OP4_SQL,
    "op10_positional_decontamination": OP10_SQL,
    "op11_content_sort": OP11_SQL,
    "op12_conversation_prefix_trie": OP12_SQL,
}
