"""Runnable queries, each next to the SQL its result is checked against."""

import importlib

MODULES = ["indicators", "frames", "trades", "outcomes", "conditions", "exits", "scoring", "statistics", "patterns", "learning", "streams", "stored", "signals", "moments", "full_scores"]


def load_catalogue():
    for m in MODULES:
        importlib.import_module(f"barloom.plans.{m}")
    from barloom.plans.registry import CATALOGUE
    return CATALOGUE
