"""Small helpers to register a query next to its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tripleframe.plans.views import duck_ctes, load
from tripleframe.session import tune


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, views: str = ""):
        """Register a function of the session; ``views`` are the derived views its SQL reads."""

        def wrap(build: Callable[[SparkSession], DataFrame]):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return build(load(tune(spark), sf_dir))

            run.__name__ = name
            run.__doc__ = build.__doc__
            self.queries[name] = run
            if sql is not None:
                ctes = duck_ctes(*views.split())
                body = sql.strip()
                if not ctes:
                    self.sql[name] = body
                elif body.upper().startswith("WITH "):
                    self.sql[name] = f"WITH {ctes}, {body[5:]}"
                else:
                    self.sql[name] = f"WITH {ctes} {body}"
            return build

        return wrap
