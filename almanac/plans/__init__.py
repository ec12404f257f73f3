"""Registered queries: the operators bound to the driver's tables, each with its SQL twin where SQL can say it."""

from importlib import import_module

FAMILIES = (
    "daily", "selection", "aggregation", "windows", "features", "forecasts", "decisions", "ledgers", "inference",
    "quality", "newsflow", "text", "learning", "storage", "streams",
)


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"almanac.plans.{family}")
