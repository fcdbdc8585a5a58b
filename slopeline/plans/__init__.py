"""Registered queries over the driver's tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from . import assets, cards, feeds, impact, models, network, records, risk, streams, tick

FLAGSHIP = "exceedance_fusion"

_MODULES = (risk, impact, network, records, cards, feeds, tick, assets, models, streams)

QUERIES = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
