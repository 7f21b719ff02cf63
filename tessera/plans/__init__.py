"""Query plans by group; each module registers its queries when imported."""

from importlib import import_module

#: Modules of this package that hold queries.
GROUPS = ("text", "postings", "relational", "entities", "retrieval", "rules", "extensions")


def load() -> None:
    for name in GROUPS:
        import_module(f"tessera.plans.{name}")
