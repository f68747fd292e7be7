"""Column functions: byte-exact edit distance, hash priorities, match predicates."""

from .hashing import draw, fraction_bound, priority, unit_below
from .text import edit_distance, fuzzy_match

__all__ = ["draw", "edit_distance", "fraction_bound", "fuzzy_match", "priority", "unit_below"]
