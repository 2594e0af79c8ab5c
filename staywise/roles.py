"""Plain descriptions of a subscriber table: column roles, input contract, rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from staywise.functions.expressions import FLAG_ALIASES


@dataclass(frozen=True)
class ColumnRoles:
    """Which column plays which part; operators take roles, never fixed names."""

    id: str
    target: str
    categoricals: tuple[str, ...]
    numerics: tuple[str, ...]
    senior: str
    tenure: str
    revenue: str
    lifetime: str
    contract: str
    service: str
    payment: str
    support: str
    security: str
    addons: tuple[str, ...]
    positive: str = "Yes"
    negative: str = "No"

    @property
    def features(self) -> tuple[str, ...]:
        return self.categoricals + self.numerics


@dataclass(frozen=True)
class ContractSpec:
    """What a record must look like before it may be scored.

    ``flags`` are 0/1 columns read through the closed ``aliases`` table, ``numerics``
    are measured numbers, ``domains`` the accepted levels per category and
    ``imputed`` the stored training statistic of the numerics that may be
    missing.  Every other missing value is a violation.
    """

    required: tuple[str, ...]
    flags: tuple[str, ...]
    numerics: tuple[str, ...]
    domains: dict[str, tuple[str, ...]]
    imputed: dict[str, float] = field(default_factory=dict)
    aliases: dict[str, int] = field(default_factory=lambda: dict(FLAG_ALIASES))


@dataclass(frozen=True)
class RuleBook:
    """Levels and limits that trigger retention actions and playbook segments."""

    flexible_contract: str
    risky_service: str
    friction_payment: str
    automatic_payment: str
    high_bill: float
    early_tenure: int = 6
    bill_floor: float = 18.0
    monthly_credit: float = 15.0
    addon_yes: str = "Yes"
    addon_no: str = "No"
