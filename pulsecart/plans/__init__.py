"""Named queries over the retail tables, each with its SQL counterpart where SQL can say it."""

from pulsecart.plans import activity, alerts, changes, sales, search, streams

MODULES = [activity, alerts, sales, search, changes, streams]


def all_queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
