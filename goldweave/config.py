"""Rules and thresholds, with both modes of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from decimal import Decimal


@dataclass(frozen=True)
class MdmConfig:
    """mode "bulk" scores whole histories with addresses, "nrt" the latest rows without; clustering is "onehop" or "transitive"."""

    mode: str = "bulk"
    clustering: str = "onehop"
    # The weights of the rules, the floors of their similarities, and the threshold.
    threshold: Decimal = Decimal("0.70")
    email: Decimal = Decimal("1.00")
    phone: Decimal = Decimal("0.95")
    canonical: Decimal = Decimal("0.80")
    name: Decimal = Decimal("0.30")
    name_floor: float = 0.85
    address: Decimal = Decimal("0.25")
    street_floor: float = 0.80
    soundex: Decimal = Decimal("0.20")
    domain_first: Decimal = Decimal("0.15")
    first_floor: float = 0.90
    phone_city: Decimal = Decimal("0.10")
    priorities: tuple[tuple[str, int], ...] = (("CRM_A", 1), ("CRM_B", 2), ("CRM_C", 3))
    candidate_limit: int = 50
    candidate_cap: int = 100
    #: Blocks of more members are left out of scored pairs, if that is asked for.
    block_limit: int = 500
    drop_large_blocks: bool = False
    # Domains and numbers that count as disposable and as placeholders.
    disposable: tuple[str, ...] = ("mailinator.com", "tempmail.com", "guerrillamail.com", "10minutemail.com")
    placeholders: tuple[str, ...] = ("0000000000", "1111111111", "1234567890")
    null_tokens: tuple[str, ...] = ("", "NULL", "null")
    source_null_tokens: tuple[tuple[str, tuple[str, ...]], ...] = field(default=(("CRM_C", ("N/A",)),))

    @property
    def other_priority(self) -> int:
        return 3 if self.mode == "bulk" else 99

    @property
    def prunable(self) -> bool:
        """Whether the name, sound and domain rules stay under the threshold even together, so that a match needs another rule."""
        return self.name + self.soundex + self.domain_first < self.threshold

    @property
    def address_needs_block(self) -> bool:
        """Whether an equal postal code, number and city, and a similar name stay under the threshold together, so that sound or domain must agree too."""
        return self.name + self.address + self.phone_city < self.threshold

    @property
    def city_needs_sound(self) -> bool:
        """Whether number and city need the sound to agree where neither postal code nor domain rule out the rest."""
        return self.name + self.domain_first + self.phone_city < self.threshold


BULK = MdmConfig()
NRT = replace(BULK, mode="nrt", clustering="transitive")
