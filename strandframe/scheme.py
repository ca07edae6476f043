"""Scoring parameters of alignments."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScoringScheme:
    """Scores of a pair of equal and of different symbols; a gap of k symbols costs gap_open + k * gap_extend.

    gap_open = 0 gives linear gaps. Values are those that a signed byte holds, and gaps must not be rewarded for opening.
    """

    match: int = 2
    mismatch: int = -5
    gap_extend: int = -2
    gap_open: int = -4

    def __post_init__(self) -> None:
        for name in ("match", "mismatch", "gap_extend", "gap_open"):
            v = getattr(self, name)
            if not isinstance(v, int) or isinstance(v, bool) or not -128 <= v <= 127:
                raise ValueError(f"{name} must be an integer from -128 to 127")
        if self.gap_open > 0:
            raise ValueError("gap_open must not be positive")

    @property
    def is_edit_distance(self) -> bool:
        """Whether the score is the negated Levenshtein distance."""
        return (self.match, self.mismatch, self.gap_extend, self.gap_open) == (0, -1, -1, 0)


DEFAULT = ScoringScheme()
#: Floor of the reported largest cell.
CELL_FLOOR = -100
#: Lanes of a vector block times the block multiplier: the unit to which a sequence is padded.
DEFAULT_BLOCK = 160
