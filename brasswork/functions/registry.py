"""Domain registry: what is active, what is planned, and what each domain maps to."""

from __future__ import annotations

from dataclasses import dataclass

from . import vocab as V


class DomainNotFound(KeyError):
    """No domain of that name."""


class DomainNotImplemented(NotImplementedError):
    """A planned domain can't be run yet."""


@dataclass(frozen=True)
class Domain:
    key: str
    active: bool
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    route: str | None = None
    prompt: str | None = None

    @property
    def fields(self) -> tuple[str, ...]:
        return self.required + self.optional


DOMAINS = {k: Domain(k, True, V.REQUIRED[k], V.OPTIONAL[k], V.ROUTES[k], V.PROMPTS[k]) for k in V.DOMAINS} | {k: Domain(k, False) for k in V.PLANNED_DOMAINS}


def domain(key: str) -> Domain:
    if key not in DOMAINS:
        raise DomainNotFound(f"{key!r}; known: {sorted(DOMAINS)}")
    return DOMAINS[key]


def require_active(key: str, operation: str = "operation") -> Domain:
    found = domain(key)
    if not found.active:
        raise DomainNotImplemented(f"{operation} needs an active domain; {key!r} is planned")
    return found


def keys(active: bool | None = None) -> list[str]:
    return sorted(k for k, d in DOMAINS.items() if active is None or d.active == active)
