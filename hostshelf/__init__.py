"""hostshelf — a Spark-native store for host-telemetry snapshots.

Typed snapshot tables, a declarative filter registry, newest-first row
paging and whole-snapshot (group) paging, keep-newest-N retention, a
session-key table with expiry, raw-sample folds, and streaming collection,
all as DataFrame / Structured Streaming code.
"""

from .functions.filters import REGISTRY, QuerySpec, resolve
from .plans.info_query import info_query
from .schemas import CPU, FILE, KINDS, NET, RAM, SESSION_KEYS, Kind, kind_of

__all__ = ["CPU", "FILE", "KINDS", "NET", "RAM", "REGISTRY", "SESSION_KEYS", "Kind", "QuerySpec",
           "info_query", "kind_of", "resolve"]
