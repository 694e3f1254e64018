"""Fixed table contracts of the snapshot store.

Every table has explicit types; nothing is inferred. All columns are NOT NULL
in the contract; files read back through Parquet report them nullable, so the
NOT NULL rule is enforced by :mod:`hostshelf.operators.validate` on write.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_I = T.IntegerType()
_L = T.LongType()
_D = T.DoubleType()
_S = T.StringType()
_TS = T.TimestampNTZType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, False) for n, t in fields])


# Column names, order and types of the five tables (the row
# contract of the store; `commited` is spelled as in the contract).
CPU = _struct(
    ("id", _I), ("group_id", _I), ("name", _S), ("physical_cores", _I),
    ("logical_cores", _I), ("utilization", _D), ("current_speed_mhz", _D),
    ("base_speed_mhz", _D), ("processes_amount", _I), ("threads_amount", _I),
    ("handles_amount", _I), ("uptime", _L), ("insertion_datetime", _TS),
)
RAM = _struct(
    ("id", _I), ("group_id", _I), ("total", _L), ("used", _L), ("free", _L),
    ("commited", _L), ("cached", _L), ("insertion_datetime", _TS),
)
NET = _struct(
    ("id", _I), ("group_id", _I), ("bytes_sent", _L), ("bytes_recv", _L),
    ("packets_sent", _L), ("packets_recv", _L), ("err_in", _L), ("err_out", _L),
    ("connections", _I), ("insertion_datetime", _TS),
)
FILE = _struct(
    ("id", _I), ("group_id", _I), ("path", _S), ("total", _L), ("used", _L),
    ("free", _L), ("used_percent", _D), ("insertion_datetime", _TS),
)
SESSION_KEYS = _struct(
    ("id", _I), ("session_key", _S), ("creation_datetime", _TS), ("valid_until", _TS),
)

# Bounded string columns and their limit (varchar(512)).
MAX_TEXT = {"name": 512, "session_key": 512}

# Defaults of the collector and key table.
DEFAULT_MAX_GROUPS = 100
DEFAULT_MAX_SESSION_KEYS = 60
DEFAULT_KEY_LIFETIME_MINUTES = 60
DEFAULT_RETRIES = 3
DEFAULT_INTERVAL_SECONDS = 30


@dataclass(frozen=True)
class Kind:
    """A snapshot table kind: its name and row schema."""

    name: str
    schema: T.StructType

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    @property
    def insert_columns(self) -> list[str]:
        """Columns a writer supplies; `id` and the insert time come from the store."""
        return [c for c in self.schema.names if c not in ("id", "insertion_datetime")]

    def field(self, column: str) -> T.StructField:
        return self.schema[column]


KINDS: dict[str, Kind] = {
    "cpu": Kind("cpu", CPU),
    "ram": Kind("ram", RAM),
    "net": Kind("net", NET),
    "file": Kind("file", FILE),
}


def kind_of(kind: str | Kind) -> Kind:
    """Resolve a kind name; an unknown kind is an error (never a silent empty result)."""
    if isinstance(kind, Kind):
        return kind
    try:
        return KINDS[kind]
    except KeyError:
        raise ValueError(f"unknown table kind: {kind!r}; expected one of {sorted(KINDS)}") from None
