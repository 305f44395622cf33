"""Run parameters and alphabets."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

#: Symbols in the order that their codes follow.
ALPHABETS = {"DNA": "ACGTN", "PROT": "ARNDCQEGHILKMFPSTWYVOUBZJX*", "USR": "0123456789"}


@dataclass(frozen=True)
class Box:
    """A further box of a structured motif: the gap before it, its length, its errors."""

    gap_min: int
    gap_max: int
    length: int
    errors: int


@dataclass(frozen=True)
class MotifParams:
    """k, e, distance ('hamming' or 'edit'), quorum q..q_max in percent, total occurrences n_min..n_max, boxes.

    alphabet is the name of one of ALPHABETS or any string of symbols.
    """

    k: int
    e: int
    q: float
    distance: str = "hamming"
    alphabet: str = "DNA"
    q_max: float = 100
    n_min: int = 1
    n_max: int = 10000
    boxes: tuple[Box, ...] = field(default=())

    def __post_init__(self) -> None:
        wrong = [
            (self.distance not in ("hamming", "edit"), "distance is 'hamming' or 'edit'"),
            (self.k < 1 or self.e < 0 or self.e >= self.k, "0 <= e < k"),
            (not 0 <= self.q <= 100 or not 0 <= self.q_max <= 100, "q and q_max are percentages"),
            (self.q > self.q_max, "q <= q_max"),
            (self.n_min < 0 or self.n_min > self.n_max, "0 <= n_min <= n_max"),
            (not self.symbols, "the alphabet has symbols"),
            (any(b.gap_min < 0 or b.gap_min > b.gap_max for b in self.boxes), "0 <= gap_min <= gap_max"),
            (any(b.errors < 0 or b.errors >= b.length for b in self.boxes), "0 <= errors < length in each box"),
        ]
        if found := [text for is_wrong, text in wrong if is_wrong]:
            raise ValueError("; ".join(found))

    @property
    def symbols(self) -> str:
        return ALPHABETS.get(self.alphabet, self.alphabet)

    @property
    def lengths(self) -> list[int]:
        return [self.k, *(b.length for b in self.boxes)]

    @property
    def errors(self) -> list[int]:
        return [self.e, *(b.errors for b in self.boxes)]

    @property
    def total_length(self) -> int:
        """Of the whole motif with the smallest gaps; shorter sequences take no part in matching but count in N."""
        return self.k + sum(b.gap_min + b.length for b in self.boxes)

    @property
    def structures(self) -> list[tuple[int, ...]]:
        """Every choice of gaps, the last gap changing fastest."""
        return list(product(*(range(b.gap_min, b.gap_max + 1) for b in self.boxes)))
