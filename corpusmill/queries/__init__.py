"""All registered queries, keyed by inventory item."""

from __future__ import annotations

from corpusmill.queries import anonymizing, cleaning, dedup, flagging, modelling, reports, sinks, tokenizing, training

MODULES = (dedup, flagging, cleaning, anonymizing, reports, tokenizing, training, modelling, sinks)
ALL = {name: query for module in MODULES for name, query in module.QUERIES.items()}
