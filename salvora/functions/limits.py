"""Limits of one document and the running budget of what it expands to."""

from __future__ import annotations

from dataclasses import dataclass, field

from salvora.functions.errors import LimitExceeded

MIB = 1 << 20


@dataclass(frozen=True)
class Limits:
    """Ceilings; dataclasses.replace() makes variants."""

    input_bytes: int = 64 * MIB
    member_bytes: int = 256 * MIB
    total_bytes: int = 256 * MIB
    ratio: int = 256
    ratio_floor: int = MIB

    def check_input(self, size: int) -> None:
        guard("input bytes", self.input_bytes, size)

    def budget(self) -> Budget:
        return Budget(self)


def guard(resource: str, limit: int, actual: int) -> None:
    if actual > limit:
        raise LimitExceeded(resource, limit, actual)


@dataclass
class Budget:
    limits: Limits = field(default_factory=Limits)
    spent: int = 0

    def reserve(self, packed: int, original: int) -> None:
        """Take `original` bytes from the budget, all or nothing, before any is allocated."""
        lim = self.limits
        guard("LH5 decompressed bytes", lim.member_bytes, original)
        guard("LH5 expansion ratio output", max(lim.ratio_floor, packed * lim.ratio), original)
        guard("total LH5 decompressed bytes", lim.total_bytes, self.spent + original)
        self.spent += original
