"""Gates over collected results, and the headline that they allow."""

from __future__ import annotations

import math

# Thresholds of the gates.
ALPHA, MOST_DROP, LEAST_MARGIN = 0.05, 0.10, 0.02


def difference_se(sd_a: float | None, n_a: int, sd_b: float | None, n_b: int) -> float | None:
    """Standard error of a difference of means; none where a side has fewer than two values."""
    if n_a < 2 or n_b < 2 or sd_a is None or sd_b is None:
        return None
    return math.sqrt(sd_a**2 / n_a + sd_b**2 / n_b)


def permutation_gate(p: float | None) -> str:
    return "untested" if p is None else "pass" if p < ALPHA else "fail"


def split_gate(random: float | None, community: float | None, se: float | None = 0.0) -> str:
    """Whether the score holds when whole communities are held out; within two standard errors of the limit is unresolved."""
    if random is None or community is None:
        return "untested"
    drop = random - community
    if abs(drop - MOST_DROP) <= 2 * (se or 0.0):
        return "unresolved"
    return "pass" if drop <= MOST_DROP else "fail"


def baseline_gate(margin: float | None, se: float | None = None, t: float = 2.0) -> str:
    """Whether the graph beats a model without it by the margin, beyond the paired error."""
    if margin is None:
        return "untested"
    if se is not None and abs(margin - LEAST_MARGIN) <= t * se:
        return "unresolved"
    return "pass" if margin >= LEAST_MARGIN else "fail"


def external_gate(metrics: dict | None) -> str:
    """Whether the model was tried on rows from elsewhere, and better than chance there."""
    if not metrics or metrics.get("balanced_accuracy") is None:
        return "untested"
    return "pass" if metrics["balanced_accuracy"] > 0.5 else "fail"


def graph_semantics_gate(semantics: str, edge_timing: str) -> str:
    """Only edges that are relations, known before the outcome, carry a claim; edges made from the features restate them."""
    if semantics == "unspecified" or edge_timing == "unknown":
        return "untested"
    return "pass" if semantics == "observed_relation" and edge_timing == "pre_outcome" else "fail"


def safety_gate(class_counts: dict[str, int], test_rows: int) -> dict:
    """What blocks a model, what downgrades it, and warnings."""
    least, labeled = min(class_counts.values(), default=0), sum(class_counts.values())
    warnings = [w for w, on in (("fewer than 50 labelled rows", labeled < 50), ("fewer than 20 test rows", test_rows < 20), ("fewer than 10 rows in the smallest class", least < 10)) if on]
    return {"blocked": len(class_counts) <= 1, "downgrade": least < 5, "warnings": warnings}


def headline(gates: dict[str, str], leakage: bool = False) -> str:
    """Fails first, then what is unresolved, leakage, what is untested."""
    for state, text in (("fail", "not supported: failed"), ("unresolved", "unresolved:")):
        if found := sorted(k for k, v in gates.items() if v == state):
            return f"{text} {', '.join(found)}"
    if leakage:
        return "possible leakage"
    if found := sorted(k for k, v in gates.items() if v == "untested"):
        return f"untested: {', '.join(found)}"
    return "supported by all gates"
