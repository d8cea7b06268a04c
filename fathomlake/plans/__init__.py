

from . import queries, statement_queries, market_queries, ledger_queries, cleaning_queries, history_queries, lake_queries  # noqa: F401
