"""Analytics domains: what fields the records of one have, and its statistics; a registry by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from . import insight as I


@dataclass(frozen=True)
class Domain:
    """``stats``: names of statistics, and what makes each of the records."""

    name: str
    signature_fields: tuple[str, ...]
    stats: dict[str, Callable[[DataFrame], DataFrame]]


REGISTRY: dict[str, Domain] = {}


def register(domain: Domain) -> Domain:
    """Adds ``domain``; a name stands for one domain only."""
    if REGISTRY.setdefault(domain.name, domain) is not domain:
        raise ValueError(f"there is a domain {domain.name} already")
    return domain


def analyse(records: DataFrame, name: str) -> dict[str, DataFrame]:
    """All statistics of domain ``name``, as tables that are not computed yet."""
    if name not in REGISTRY:
        raise KeyError(f"no domain {name}; there are {', '.join(sorted(REGISTRY))}")
    domain = REGISTRY[name]
    if missing := [f for f in domain.signature_fields if f not in records.columns]:
        raise ValueError(f"records of {name} need {', '.join(missing)}")
    return {stat: make(records) for stat, make in domain.stats.items()}


def coverage(records: DataFrame, order: list, n: int = 50, names: list[str] | None = None) -> DataFrame:
    """`insight.domain_coverage` of the registered domains, or of those in ``names``."""
    return I.domain_coverage(records, {d: list(REGISTRY[d].signature_fields) for d in names or sorted(REGISTRY)}, order, n)


SALES = register(Domain("sales", ("date", "amount"), {"daily": I.daily_sales, "weekdays": lambda r: I.weekday_mean(I.daily_sales(r)), "anomalies": lambda r: I.anomalies(I.daily_sales(r))}))
VOC = register(Domain("voc", ("date", "text"), {"ratings": I.rating_stats, "surges": I.daily_surge, "sample": I.feedback_sample}))
