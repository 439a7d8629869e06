"""The registered queries over the given tables, each with a SQL oracle where one exists."""

from registry import pixel, profiles, quality, server, settings, state, streams

CATALOGS = (server.catalog, state.catalog, pixel.catalog, settings.catalog, streams.catalog, profiles.catalog, quality.catalog)

QUERIES = {name: q for c in CATALOGS for name, q in c.queries.items()}
ORACLES = {name: text for c in CATALOGS for name, text in c.oracles.items()}
