"""palisade: governed access to Spark tables and streams.

Policies, masks, decisions and audit analytics are Column expressions and
DataFrame joins; nothing here runs row-at-a-time Python.
"""

from palisade.operators.enforce import AccessDenied, GovernedTable, governed_table
from palisade.plans.governed_sql import GovernedSession
from palisade.sources.policy import Bundle
from palisade.sources.registry import Registry

__all__ = ["AccessDenied", "Bundle", "GovernedSession", "GovernedTable", "Registry", "governed_table"]
