"""Limits of the flows. Fixed values that results have to agree with; all are arguments of the operators that use them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    """Budgets, thresholds and caps of collection and hygiene runs."""

    run_sessions: int = 3
    run_messages: int = 150
    live_minutes: int = 30
    trivial_messages: int = 4
    window_messages: int = 30
    tail_messages: int = 5
    person_confidence: int = 3
    run_mutations: int = 25
    run_comparisons: int = 50
    first_run_items: int = 200
    duplicate_similarity: float = 0.90
    stale_days: int = 30
    decay_notch: float = 0.1
    decay_floor: float = 0.0
    bloat_chars: int = 750
    run_splits: int = 5
    run_reconnects: int = 10
    cluster_searches: int = 6
    search_hits: int = 6
    description_chars: int = 500
    technical_chars: int = 900


LIMITS = Limits()

#: The kinds that records may have.
CATEGORIES = ("Interest", "Goal", "Dream", "Conflict", "Concern", "Fear", "Hope", "Plan", "Project", "Event", "Technical")
ROLES = ("user", "assistant")
