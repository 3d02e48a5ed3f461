"""All queries, grouped by family."""

import importlib

FAMILIES = ("indicators", "screens", "bars", "patterns", "structure", "signals", "positioning", "audits", "walls", "texts", "ledgers", "reports", "alerts", "streams")


def load():
    from barloom.catalog import base

    for family in FAMILIES:
        importlib.import_module(f"barloom.catalog.{family}")
    return base.QUERIES, base.ORACLES
