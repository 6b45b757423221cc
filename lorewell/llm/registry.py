"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

_MODULES = ("near_dedup", "warc", "fingerprints", "packing", "license_scan", "html_text", "piece_tokens", "substring_dedup", "quality_rules", "token_output")


def queries() -> dict:
    out = {}
    for m in _MODULES:
        out |= importlib.import_module(f"{__package__}.{m}").QUERIES
    return out


def oracle_sql() -> dict:
    out = {}
    for m in _MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{m}"), "SQL", {})
    return out
