"""The same results in DuckDB SQL, for checking."""

from __future__ import annotations

import re
from functools import cache
from pathlib import Path

_HERE = Path(__file__).parent


@cache
def _views() -> dict[str, str]:
    """Named sub-queries from ``views.sql``, in an order where each uses only earlier ones."""
    text = (_HERE / "views.sql").read_text()
    blocks = re.split(r"^-- view (\w+)\n", text, flags=re.MULTILINE)[1:]
    return {name: body.strip().rstrip(";") for name, body in zip(blocks[::2], blocks[1::2], strict=True)}


def with_views(query: str) -> str:
    """``query`` with a WITH clause of every named sub-query it reaches."""
    views = _views()
    needed: set[str] = set()
    pending = [query]
    while pending:
        words = set(re.findall(r"\w+", pending.pop()))
        found = (words & views.keys()) - needed
        needed |= found
        pending += [views[name] for name in found]
    clauses = ",\n".join(f"{name} AS (\n{body}\n)" for name, body in views.items() if name in needed)
    return f"WITH {clauses}\n{query}" if clauses else query
