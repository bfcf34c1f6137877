"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from landq.llm.chat import OP2_SQL, op2_chat
from landq.llm.collocations import OP11_SQL, op11_collocations
from landq.llm.lexicon import op6_bpe
from landq.llm.lines import OP13_SQL, op13_shared_lines
from landq.llm.manifest import OP12_SQL, op12_manifest
from landq.llm.near_duplicates import OP4_SQL, op4_near_duplicates
from landq.llm.outliers import op7_quality, op7_sql
from landq.llm.packing import op8_packing
from landq.llm.repeats import OP5_SQL, op5_repeats
from landq.llm.sharding import op10_sharding
from landq.llm.token_files import op3_token_files
from landq.llm.top_k import OP1_SQL, op1_top_k
from landq.llm.warc import OP9_SQL, op9_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_top_k,
        op2_chat,
        op3_token_files,
        op4_near_duplicates,
        op5_repeats,
        op6_bpe,
        op7_quality,
        op8_packing,
        op9_warc,
        op10_sharding,
        op11_collocations,
        op12_manifest,
        op13_shared_lines,
    )
}

SQL: dict[str, str] = {
    "op1_top_k": OP1_SQL,
    "op2_chat": OP2_SQL,
    "op4_near_duplicates": OP4_SQL,
    "op5_repeats": OP5_SQL,
    "op7_quality": op7_sql(),
    "op9_warc": OP9_SQL,
    "op11_collocations": OP11_SQL,
    "op12_manifest": OP12_SQL,
    "op13_shared_lines": OP13_SQL,
}
