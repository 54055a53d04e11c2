"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from storyweft.llm.chat import op3_chat_formatting
from storyweft.llm.clusters import OP13_SQL, op13_centroid_clustering
from storyweft.llm.jaccard import op5_ngram_jaccard
from storyweft.llm.language import op8_language_id
from storyweft.llm.lines import op7_line_dedup
from storyweft.llm.media import op4_media_columns
from storyweft.llm.mixing import op9_mixing
from storyweft.llm.oracles import CHAT_SQL, MIX_SQL, OP1_SQL, OP5_SQL, OP7_SQL
from storyweft.llm.packing import op6_best_fit_packing
from storyweft.llm.runs import OP12_SQL, op12_periodic_runs
from storyweft.llm.substrings import op1_suffix_array_dedup
from storyweft.llm.tokenfiles import op11_token_index
from storyweft.llm.topk import OP10_SQL, op10_exact_top_k
from storyweft.llm.toxicity import op2_toxicity



def chat_digests(spark, sf_dir):
    """The columns of op3 that SQL can say: all but the length of what was formatted."""
    return op3_chat_formatting(spark, sf_dir).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


def mix_targets(spark, sf_dir):
    """The columns of op9 that SQL can say: sizes and targets, not what was drawn."""
    return op9_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_media_columns": op4_media_columns,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_language_id": op8_language_id,
    "op9_mixing": op9_mixing,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_token_index": op11_token_index,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_centroid_clustering": op13_centroid_clustering,
    "chat_digests": chat_digests,
    "mix_targets": mix_targets,
}
ORACLE_SQL = {"op1_suffix_array_dedup": OP1_SQL, "op5_ngram_jaccard": OP5_SQL, "op7_line_dedup": OP7_SQL, "op10_exact_top_k": OP10_SQL, "op12_periodic_runs": OP12_SQL, "op13_centroid_clustering": OP13_SQL, "chat_digests": CHAT_SQL, "mix_targets": MIX_SQL}
