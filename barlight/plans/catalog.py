"""The engine's queries by name, with their DuckDB SQL."""

from barlight.plans import features, registry, relations, scalars, screens  # noqa: F401

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES


def flagship(spark, sf_dir):
    return QUERIES["screen_single"](spark, sf_dir)
