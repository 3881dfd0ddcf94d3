"""Every registered query."""

from __future__ import annotations

from costproof.plans import cascades, conversations, labels, ledgers, monitoring, prompts, proofs  # noqa: F401
from costproof.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
