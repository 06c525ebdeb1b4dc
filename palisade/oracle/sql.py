"""Assembles the DuckDB check queries: named CTEs (prefix ``q_``) are pulled in where they are referenced."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}
_NAME = re.compile(r"\bq_\w+\b")


def cte(name: str, body: str) -> None:
    if name in CTES:
        raise ValueError(f"duplicate CTE {name}")
    CTES[name] = body


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    body = ",\n".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


def strlist(items) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


def compose(final: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(_NAME.findall(text)):
            if name in CTES and name not in needed:
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(final)
    if not needed:
        return final
    bodies = [CTES[n] for n in needed] + [final]
    uses = {n: sum(len(re.findall(rf"\b{n}\b", b)) for b in bodies) for n in needed}
    head = ",\n".join(f"{n} AS {'MATERIALIZED ' if uses[n] > 1 else ''}({CTES[n]})" for n in needed)
    body = final.strip()
    for opener, keyword in (("WITH RECURSIVE ", "WITH RECURSIVE"), ("WITH ", "WITH")):
        if body.upper().startswith(opener):
            return f"{keyword} {head},\n{body[len(opener):]}"
    return f"WITH {head}\n{final}"
