"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import batches, formatting, leaks, lookalikes, matching, mixing, names, places, residue
from .oracle import ORACLE

QUERIES = {
    "p1_found": matching.found,
    "p1_confidences": matching.confidences,
    "p2_found": batches.found,
    "p3_found": places.found,
    "p4_found": formatting.found,
    "p4_copies": formatting.collapsed,
    "p5_found": lookalikes.found,
    "p5_forms": lookalikes.all_forms,
    "p6_found": names.found,
    "p7_found": leaks.found,
    "p7_items": leaks.by_item,
    "p8_mix": mixing.mixed,
    "p8_shares": mixing.report,
    "p9_found": residue.found,
    "p9_reasons": residue.reasons,
}

__all__ = ["ORACLE", "QUERIES"]
