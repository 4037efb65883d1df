"""Independent SQL for the named queries, run on the same tables by the correctness check."""

from __future__ import annotations

import re

from mergescope.oracle.views import VIEWS


def with_views(body: str) -> str:
    """Prepend the views a statement uses, directly or through other views, in definition order."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        text = pending.pop()
        for name, definition in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                pending.append(definition)
    if not needed:
        return body.strip()
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in VIEWS if name in needed]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


def statements() -> dict[str, str]:
    from mergescope.oracle import cohorts, operators, reports, streams, texts

    out: dict[str, str] = {}
    for module in (operators, reports, cohorts, texts, streams):
        for name, body in module.SQL.items():
            out[name] = with_views(body)
    return out
