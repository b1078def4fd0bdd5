"""Likelihoods of bases and genotypes as column expressions. Genotypes: AA AC AG AT CC CG CT GG GT TT."""

from __future__ import annotations

from itertools import combinations_with_replacement
from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F

GENOTYPES = tuple(combinations_with_replacement(range(4), 2))


def quality_terms(most: int = 93) -> tuple[list[float], list[float], list[float]]:
    """For the qualities 1 to most: ln P(base | genotype) of a base in neither allele, and what one match of two, or two, adds."""
    eps = [10 ** (-q / 10) for q in range(1, most + 1)]
    miss = [log(e / 3) for e in eps]
    return miss, [log((1 - e + e / 3) / 2) - m for e, m in zip(eps, miss, strict=True)], [log(1 - e) - m for e, m in zip(eps, miss, strict=True)]


def genotype_logs(miss: str = "s_miss", one: str = "s_one", two: str = "s_two") -> Column:
    """The ten log likelihoods of a site from its sums: of misses, and by base what one and two matches add."""
    return F.array(*((F.col(miss) + F.col(f"{two}{a}")) if a == b else (F.col(miss) + F.col(f"{one}{a}") + F.col(f"{one}{b}")) for a, b in GENOTYPES))


def scaled_ten(logs: str, n: int = 10) -> Column:
    """Likelihoods with the greatest 1; it is worked out once, as the number of them is fixed."""
    each = [F.element_at(logs, i + 1) for i in range(n)]
    top = F.greatest(*each)
    return F.array(*(F.exp(x - top) for x in each))
