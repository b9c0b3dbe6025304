"""All queries of the core with their SQL."""

from slatework.plans import base, heat, joins, runs, scalars, spatial, training  # noqa: F401

QUERIES = {**base.QUERIES, **training.QUERIES}
SQL = {**base.SQL, **training.SQL}
