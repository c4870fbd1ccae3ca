"""Queries over the bound tables, grouped by area."""

from importlib import import_module

AREAS = ("scored", "joined", "sequences", "grouped", "past", "chance", "equipped", "situated", "reviewed", "watched", "rated", "drafted", "filed", "documents", "loadouts", "ranked", "noted", "learned", "held_out", "streams")


def load_all() -> None:
    for area in AREAS:
        import_module(f"{__name__}.{area}")
