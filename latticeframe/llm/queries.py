"""The subpackage's queries and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from .ann import OP10_SQL, op10_ann
from .chat_format import OP4_SQL, op4_chat_format
from .decontaminate import op6_decontaminate
from .language_id import op9_language_id
from .line_dedup import OP5_SQL, op5_line_dedup
from .mixing import op2_mixing
from .near_dedup import OP8_SQL, op8_near_dedup
from .pii import op7_pii
from .token_output import op3_token_output
from .url_filter import OP1_SQL, op1_url_filter


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_mixing, op3_token_output, op4_chat_format, op5_line_dedup, op6_decontaminate, op7_pii, op8_near_dedup, op9_language_id, op10_ann, pipeline)}

#: The others can't be written in SQL; tests/llm holds them against brute force, round trips or held-out accuracy.
ORACLES = {"op1_url_filter": OP1_SQL, "op4_chat_format": OP4_SQL, "op5_line_dedup": OP5_SQL, "op8_near_dedup": OP8_SQL, "op10_ann": OP10_SQL}
