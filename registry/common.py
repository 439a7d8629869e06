"""Registration of a query together with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable


class Catalog:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, oracle: str | None = None, name: str | None = None):
        def keep(function):
            key = name or function.__name__
            self.queries[key] = function
            if oracle is not None:
                self.oracles[key] = oracle
            return function

        return keep
