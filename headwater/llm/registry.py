"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import (
    best_fit_packing, centroid_clusters, chat, decontaminate, line_dedup, mixing, phrases, quality, secrets, simhash, suffix_dedup, training_order, url_filter,
)

_MODULES = (
    secrets, training_order, mixing, line_dedup, chat, simhash, quality, url_filter, decontaminate, suffix_dedup, best_fit_packing, centroid_clusters, phrases,
)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in vars(m).items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in getattr(m, "SQL", {}).items()}
