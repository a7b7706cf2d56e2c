"""Policy profiles (driver-side configuration)."""

from __future__ import annotations

import warnings
from dataclasses import dataclass


@dataclass(frozen=True)
class PolicyConfig:
    profile: str
    require_redaction: bool
    allow_full_rehydration: bool
    encrypt_vault: bool
    audit_log: bool
    outbound_scrub: bool


# The two profiles.
STRICT = PolicyConfig(
    profile="strict",
    require_redaction=True,
    allow_full_rehydration=False,
    encrypt_vault=True,
    audit_log=True,
    outbound_scrub=True,
)

TRUSTED = PolicyConfig(
    profile="trusted",
    require_redaction=True,
    allow_full_rehydration=True,
    encrypt_vault=True,
    audit_log=False,
    outbound_scrub=False,
)


class PolicyViolation(Exception):
    """An operation the chosen profile forbids."""


def policy(profile: str) -> PolicyConfig:
    """``strict`` is strict; every other name is trusted, with a warning if it is not a known profile."""
    if profile == STRICT.profile:
        return STRICT
    if profile != TRUSTED.profile:
        warnings.warn(f"unknown profile {profile!r}, using {TRUSTED.profile!r}", stacklevel=2)
    return TRUSTED


@dataclass(frozen=True)
class CategoryRule:
    """What to do with one sensitive category.

    ``redact``: ``token`` (numbered, kept in the vault), ``hash`` (keyed pseudonym) or ``none``.
    ``reversible``: whether originals are kept.  ``export``: ``allow`` or ``deny`` (removed from outbound text).
    """

    redact: str = "token"
    reversible: bool = True
    export: str = "allow"

    def __post_init__(self):
        if self.redact not in ("token", "hash", "none"):
            raise ValueError(f"redact must be token, hash or none, not {self.redact!r}")
        if self.export not in ("allow", "deny"):
            raise ValueError(f"export must be allow or deny, not {self.export!r}")
