"""Approximate distinct counts on Spark: hashes, register sketches, estimates, and their streams."""

from .functions.hashes import get_hash, hash_keys, hash_names, register_hash
from .functions.sql import register_sql_functions, register_view
from .operators.estimate import estimate_registers
from .operators.quality import error_report
from .operators.registers import build_registers, merge_registers
from .operators.sketch import Sketch, approx_distinct

__all__ = [
    "Sketch", "approx_distinct", "build_registers", "error_report", "estimate_registers", "get_hash", "hash_keys",
    "hash_names", "merge_registers", "register_hash", "register_sql_functions", "register_view",
]
