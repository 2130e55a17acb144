"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .audio import op7_telephony
from .chat import op1_chat
from .minhash import op3_minhash
from .packing import op6_packing
from .pieces import op8_pieces
from .quality import op5_quality
from .sentences import OP2_SQL, op2_sentences
from .suffixes import OP10_SQL, op10_suffixes
from .topk import OP9_SQL, op9_topk
from .urls import OP4_SQL, op4_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_sentences": op2_sentences,
    "op3_minhash": op3_minhash,
    "op4_urls": op4_urls,
    "op5_quality": op5_quality,
    "op6_packing": op6_packing,
    "op7_telephony": op7_telephony,
    "op8_pieces": op8_pieces,
    "op9_topk": op9_topk,
    "op10_suffixes": op10_suffixes,
}

ORACLES: dict[str, str] = {"op2_sentences": OP2_SQL, "op4_urls": OP4_SQL, "op9_topk": OP9_SQL, "op10_suffixes": OP10_SQL}
