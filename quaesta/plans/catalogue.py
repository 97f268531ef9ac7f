"""All queries of the core and, where SQL can express them, the equivalent SQL."""

from quaesta.plans import data_queries, more_queries, reference_queries

QUERIES = {**reference_queries.QUERIES, **more_queries.QUERIES, **data_queries.QUERIES}
SQL = {**reference_queries.SQL, **more_queries.SQL, **data_queries.SQL}
