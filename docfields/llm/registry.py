"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docfields.llm.balanced_packing import op13_balanced_packing
from docfields.llm.exact_topk import OP4_SQL, op4_exact_topk
from docfields.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from docfields.llm.language_id import op7_language_id
from docfields.llm.near_dedup import op10_minhash_near_dedup
from docfields.llm.packing import op6_best_fit_packing
from docfields.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from docfields.llm.quality_rules import op8_quality_rules
from docfields.llm.sentencepiece_codec import op2_sentencepiece
from docfields.llm.sharding import op9_sharding
from docfields.llm.token_counts import op1_token_counts
from docfields.llm.toxicity import op3_toxicity
from docfields.llm.warc_fixity import OP5_SQL, op5_warc_fixity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_sentencepiece,
        op3_toxicity,
        op4_exact_topk,
        op5_warc_fixity,
        op6_best_fit_packing,
        op7_language_id,
        op8_quality_rules,
        op9_sharding,
        op10_minhash_near_dedup,
        op11_hard_negatives,
        op12_prefix_trie,
        op13_balanced_packing,
    )
}
ORACLES = {"op4_exact_topk": OP4_SQL, "op5_warc_fixity": OP5_SQL, "op11_hard_negatives": OP11_SQL, "op12_prefix_trie": OP12_SQL}
