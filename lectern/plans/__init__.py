"""Registered queries: name -> (query, SQL or None)."""

from lectern.plans import live, more, rules, state, structure, text

QUERIES = {**text.QUERIES, **structure.QUERIES, **state.QUERIES, **rules.QUERIES, **live.QUERIES, **more.QUERIES}
