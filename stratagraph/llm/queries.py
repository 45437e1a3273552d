"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import OP2_SQL, op2_decontaminate
from .html_extract import op8_html_text
from .language_id import op6_language_id
from .line_dedup import OP3_SQL, op3_line_dedup
from .mixture import OP5_SQL, op5_mixture
from .pii import op4_pii
from .simhash import op10_simhash
from .substring_dedup import op7_substring_dedup
from .token_count import op1_token_count
from .topk import OP9_SQL, op9_top_k


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_count, op2_decontaminate, op3_line_dedup, op4_pii, op5_mixture, op6_language_id, op7_substring_dedup, op8_html_text, op9_top_k, op10_simhash)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": OP2_SQL, "op3_line_dedup": OP3_SQL, "op5_mixture": OP5_SQL, "op9_top_k": OP9_SQL}
