"""Loads the modules that register this subpackage's queries."""

from almanac.llm import (  # noqa: F401
    forest, lattice, leaks, manifest, periodic, perspectives, private, quality, repeats, revisits, simhash, token_counts, url_rules,
)
from almanac.llm.base import ORACLES, QUERIES  # noqa: F401
