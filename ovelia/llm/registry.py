"""Queries and SQL of this subpackage, as __spark_entry__.py adds them."""

from __future__ import annotations

from . import chat, exact, language, licenses, mixing, near, pieces, quality, substrings, toxicity

QUERIES = {
    "op1_mixing": mixing.op1,
    "op2_substrings": substrings.op2,
    "op3_licenses": licenses.op3,
    "op4_near": near.op4,
    "op5_pieces": pieces.op5,
    "op6_exact": exact.op6,
    "op7_language": language.op7,
    "op8_chat": chat.op8,
    "op9_toxicity": toxicity.op9,
    "op10_quality": quality.op10,
}
SQL = {
    "op2_substrings": substrings.SQL2,
    "op3_licenses": licenses.SQL3,
    "op4_near": near.SQL4,
    "op6_exact": exact.SQL6,
    "op8_chat": chat.SQL8,
    "op10_quality": quality.SQL10,
}
