"""Data classes and clearance, as SQL expressions over given SQL expressions."""

from __future__ import annotations

# Data classes from least to most sensitive; the rank is the position.
CLASSES = ("public", "internal", "confidential", "restricted", "pii", "phi", "pci")
_KNOWN = ", ".join(f"'{c}'" for c in CLASSES)


def class_rank(name: str) -> str:
    """SQL: rank of a class; unknown and missing classes rank 0."""
    return f"CAST(greatest(array_position(array({_KNOWN}), {name}) - 1, 0) AS int)"


def clearance(allowed: str) -> str:
    """SQL: highest rank of a list of classes; -1 (clears nothing) when the list is empty."""
    return f"coalesce(array_max(transform({allowed}, c -> {class_rank('c')})), -1)"


def rank_of(name: str) -> int:
    return CLASSES.index(name) if name in CLASSES else 0
