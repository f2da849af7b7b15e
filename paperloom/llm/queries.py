"""The text operators' queries by name, and SQL where an operator has an exact SQL form."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from ..session import shipped

MODULES = ("p1_scan_noise", "p2_language", "p3_truncation", "p4_pairs", "p5_repetition", "p6_residue", "p7_alignment", "p8_encoding", "p9_packing", "p10_abuse")


def queries() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for m in MODULES:
        out |= importlib.import_module(f"{__package__}.{m}").QUERIES
    return {k: shipped(f) for k, f in out.items()}


def oracle_sql() -> dict[str, str]:
    return {}
