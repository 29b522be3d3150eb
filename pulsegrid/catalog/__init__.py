"""All registered queries and their SQL twins."""

from pulsegrid.catalog.base import ORACLES, QUERIES
from pulsegrid.catalog import labelling, plans, scores, signals, tables  # noqa: F401


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLES)
