"""Imports every query family."""

from importlib import import_module

FAMILIES = ("sources", "events", "names", "features", "matching", "panel", "statistics", "topk",
            "comps", "recipe", "blends", "evaluation", "models", "exports", "points", "files", "bundles")


def load() -> None:
    for family in FAMILIES:
        import_module(f"cohortcast.plans.{family}")
