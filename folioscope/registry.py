"""All registered queries outside the training-data subpackage, and their SQL."""

from __future__ import annotations

from folioscope.plans import discovery, exchange, graphs, layout, library, lists, queries, quotes, results, rules, scalars, scholarly, store

QUERIES = queries.QUERIES | library.QUERIES | store.QUERIES | scalars.QUERIES | graphs.QUERIES | exchange.QUERIES | layout.QUERIES | discovery.QUERIES | scholarly.QUERIES | quotes.QUERIES | results.QUERIES | rules.QUERIES | lists.QUERIES
ORACLES = queries.ORACLES | library.ORACLES | store.ORACLES | scalars.ORACLES | graphs.ORACLES | exchange.ORACLES | layout.ORACLES | discovery.ORACLES | scholarly.ORACLES | quotes.ORACLES | results.ORACLES | rules.ORACLES | lists.ORACLES
FLAGSHIP = "retrieval_ranked_passages"
