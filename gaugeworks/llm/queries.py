"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm import (
    chunk_bpe,
    collocations,
    embedding_dedup,
    language,
    lexical_search,
    line_dedup,
    neighbours,
    ngram_join,
    packing,
    pieces,
    sharding,
    suffix_dedup,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_embedding_near_dedup": embedding_dedup.op3_embedding_near_dedup,
    "op4_merge_dropout_pieces": pieces.op4_merge_dropout_pieces,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_compression_language": language.op6_compression_language,
    "op7_hilbert_sharding": sharding.op7_hilbert_sharding,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_multiprobe_neighbours": neighbours.op9_multiprobe_neighbours,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_collocations": collocations.op11_collocations,
    "op12_chunk_bpe": chunk_bpe.op12_chunk_bpe,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op3_embedding_near_dedup": embedding_dedup.OP3_SQL,
    "op5_ngram_join": ngram_join.OP5_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op13_lexical_search": lexical_search.OP13_SQL,
}
