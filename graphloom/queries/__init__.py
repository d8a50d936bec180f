"""Queries over the star schema and the text tables, one or more per operator, each with its SQL."""

from graphloom.queries import graph, memory, modal, ops, plans, recovery, text  # noqa: F401
from graphloom.queries.registry import QUERIES, SQL  # noqa: F401
