"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import mixing, ranked_search, vector_codes, warc
from loomgraph.llm.decontamination import op8_decontamination
from loomgraph.llm.mixing import op2_mixing
from loomgraph.llm.nearest import op11_nearest
from loomgraph.llm.ngram_join import op7_ngram_join
from loomgraph.llm.quality_classifier import op10_quality_classifier
from loomgraph.llm.quality_rules import op4_quality_rules
from loomgraph.llm.ranked_search import op13_ranked_search
from loomgraph.llm.substring_dedup import op6_substring_dedup
from loomgraph.llm.token_counts import op5_token_counts
from loomgraph.llm.toxicity import op1_toxicity
from loomgraph.llm.url_filter import op3_url_filter
from loomgraph.llm.vector_codes import op12_vector_codes
from loomgraph.llm.warc import op9_warc

QUERIES = (op1_toxicity, op2_mixing, op3_url_filter, op4_quality_rules, op5_token_counts, op6_substring_dedup, op7_ngram_join, op8_decontamination, op9_warc, op10_quality_classifier, op11_nearest, op12_vector_codes, op13_ranked_search)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.SQL, "op9_warc": warc.SQL, "op12_vector_codes": vector_codes.SQL, "op13_ranked_search": ranked_search.SQL}
