"""A dataset's configuration: mode, partitioning, and tables with the settings of their verification."""

from __future__ import annotations

from dataclasses import dataclass, field

MODES = ("strict", "strict_chunked", "partitioned_scale_mode")
NULL_KEYS = ("quarantine", "dead_letter", "singleton", "derive")
KEY_CHANGES = ("quarantine", "dead_letter", "reject", "emit_move")


@dataclass(frozen=True)
class Table:
    schema: str
    name: str
    primary_key: str
    excluded_columns: tuple[str, ...] = ()

    @property
    def relation(self) -> str:
        return f"{self.schema}.{self.name}"


@dataclass(frozen=True)
class Dataset:
    id: str
    mode: str = "strict"
    partition_count: int = 1
    key_column: str | None = None
    null_key_policy: str = "quarantine"
    key_change_policy: str = "quarantine"
    tables: tuple[Table, ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        for value, known, what in ((self.mode, MODES, "mode"), (self.null_key_policy, NULL_KEYS, "null key policy"), (self.key_change_policy, KEY_CHANGES, "key change policy")):
            if value not in known:
                raise ValueError(f"unknown {what}: {value}")
        if self.partition_count < 1 or (self.mode == "partitioned_scale_mode" and not self.key_column):
            raise ValueError("a partitioned dataset needs partitions and a key column")
        if len({t.relation for t in self.tables}) != len(self.tables):
            raise ValueError("a relation is configured twice")


def parse(document: dict) -> Dataset:
    """The dataset of a configuration document, as read from YAML or JSON."""
    d = document["dataset"]
    p = d.get("partition", {})
    tables = tuple(Table(t["schema"], t["name"], t["verify"]["primary_key"], tuple(t["verify"].get("excluded_columns", ()))) for t in d.get("tables", ()))
    return Dataset(d["id"], d.get("mode", "strict"), p.get("partition_count", 1), p.get("key_column"), p.get("null_key_policy", "quarantine"), p.get("key_change_policy", "quarantine"), tables)
