"""shelfcheck: stock reconciliation on Spark DataFrames.

Book (offline ERP) stock is lined up with the stock two online platforms show, per
(customer, store, product); the result is rolled up, checked per outlet and reported.
Every operator is a function DataFrame -> DataFrame built from Spark SQL expressions.
"""

from shelfcheck.session import build_session, checkpoint_root

__all__ = ["build_session", "checkpoint_root"]
