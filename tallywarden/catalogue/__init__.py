"""Every operator as a query over the stored tables, with its SQL equivalent."""

from importlib import import_module

GROUPS = ("integrity", "amounts", "behaviour", "counterparties", "protection", "reporting", "streams")

QUERIES, ORACLE = {}, {}
for _group in GROUPS:
    _module = import_module(f"{__name__}.{_group}")
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
