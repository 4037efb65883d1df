"""Named analytical queries over a warehouse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from mergescope.sources.warehouse import Warehouse

Plan = Callable[[Warehouse], DataFrame]


def all_plans() -> dict[str, Plan]:
    from mergescope.plans import cohorts, operators, reports, streams, texts

    plans: dict[str, Plan] = {}
    for module in (operators, reports, cohorts, texts, streams):
        for name, plan in module.PLANS.items():
            if name in plans:
                raise ValueError(f"query {name} is defined twice")
            plans[name] = plan
    return plans
