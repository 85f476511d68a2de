"""Declarations of layers: frozen, validated when made."""

from __future__ import annotations

import enum
import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from .errors import LayerConfigError

# Columns that readers of bases and views rely on.
DELETED = "_overlay_deleted"
ORIGIN = "_overlay_origin"


class Strategy(enum.Enum):
    """How source ids appear in the view and where new base ids come from."""

    NEGATIVE_ID = "negative_id"
    NEGATIVE_SOURCE_POSITIVE_BASE_ID = "negative_source_positive_base_id"
    NEGATIVE_BASE_POSITIVE_SOURCE_ID = "negative_base_positive_source_id"
    UUID4 = "uuid4"
    UUID7 = "uuid7"
    UUID7_POLYFILL = "uuid7_polyfill"

    @property
    def integer(self) -> bool:
        return not self.name.startswith("UUID")

    @property
    def negates_source(self) -> bool:
        return self is Strategy.NEGATIVE_ID

    @property
    def direction(self) -> int:
        """Sign of new base ids; 0 where they are not a sequence."""
        return 0 if not self.integer else -1 if self is Strategy.NEGATIVE_BASE_POSITIVE_SOURCE_ID else 1


def _flag(value: object, name: str) -> None:
    if not isinstance(value, bool):
        raise LayerConfigError(f"{name} must be a bool, not {value!r}")


@dataclass(frozen=True)
class SourceSpec:
    """The source's id column, a filter that always holds for visible source rows, and its partition column."""

    id_column: str = "id"
    extra_where: str = ""
    partition_key: str | None = None


@dataclass(frozen=True)
class Unique:
    """Columns unique over both layers, among live rows that meet ``condition``; nulls never collide."""

    columns: tuple[str, ...]
    condition: str | None = None

    def __post_init__(self) -> None:
        if not self.columns or not all(isinstance(c, str) for c in self.columns):
            raise LayerConfigError("a unique constraint needs column names; expressions are refused")


@dataclass(frozen=True)
class Relation:
    """``column`` of ``from_table`` holds the view id of ``to_table``."""

    from_table: str
    column: str
    to_table: str
    kind: str = "many_to_one"
    nullable: bool = True
    on_delete: str = "cascade"
    enforced: bool = True
    partition_column: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in ("many_to_one", "one_to_one"):
            raise LayerConfigError(f"unknown relation kind {self.kind!r}")
        if self.on_delete not in ("cascade", "protect", "set_null", "do_nothing"):
            raise LayerConfigError(f"unknown on_delete {self.on_delete!r}")
        if self.on_delete == "set_null" and not self.nullable:
            raise LayerConfigError("set_null needs a nullable column")


@dataclass(frozen=True)
class RedundantPolicy:
    """What an update does to rows it would not change."""

    mode: str = "materialize"
    scope: str = "source_only"
    ignore: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.mode not in ("materialize", "skip", "warn", "raise"):
            raise LayerConfigError(f"unknown mode {self.mode!r}")
        if self.scope not in ("source_only", "all"):
            raise LayerConfigError(f"unknown scope {self.scope!r}")


@dataclass(frozen=True)
class LayerSpec:
    """One layered table. ``columns`` are the declared columns, the key among them."""

    name: str
    columns: tuple[str, ...]
    pk: str = "id"
    source: SourceSpec = field(default_factory=SourceSpec)
    strategy: Strategy = Strategy.UUID4
    soft_delete: bool = True
    overridable: bool = True
    pk_default_sql: str | None = None
    redundant: RedundantPolicy = field(default_factory=RedundantPolicy)
    unique: tuple[Unique, ...] = ()
    checks: tuple[str, ...] = ()
    pk_is_relation: bool = False

    def __post_init__(self) -> None:
        if not isinstance(self.source, SourceSpec):
            raise LayerConfigError(f"{self.name}: a layer needs a source")
        if not isinstance(self.strategy, Strategy):
            raise LayerConfigError(f"{self.name}: unknown strategy {self.strategy!r}")
        _flag(self.soft_delete, "soft_delete")
        _flag(self.overridable, "overridable")
        if self.pk not in self.columns:
            raise LayerConfigError(f"{self.name}: the key {self.pk!r} is not a column")
        if len(set(self.columns)) != len(self.columns):
            raise LayerConfigError(f"{self.name}: a column is declared twice")
        for reserved in (DELETED, ORIGIN):
            if reserved in self.columns:
                raise LayerConfigError(f"{self.name}: {reserved} is reserved")
        for name in self.redundant.ignore:
            if name not in self.columns:
                raise LayerConfigError(f"{self.name}: ignored column {name!r} is unknown")
        for constraint in self.unique:
            if unknown := set(constraint.columns) - set(self.columns):
                raise LayerConfigError(f"{self.name}: unique constraint on unknown {sorted(unknown)}")
            if constraint.condition and re.search(rf"\b{re.escape(self.pk)}\b", constraint.condition):
                raise LayerConfigError(f"{self.name}: a condition names the key")

    @property
    def view_name(self) -> str:
        return f"{self.name}_view"

    @property
    def anti_join(self) -> str | None:
        """Which base rows hide source rows: ``full``, ``tombstones`` or none at all."""
        return "full" if self.overridable else "tombstones" if self.soft_delete else None

    def check_key_type(self, kind: T.DataType) -> None:
        integer = isinstance(kind, (T.IntegerType, T.LongType, T.ShortType))
        if self.pk_default_sql is None and not self.pk_is_relation and integer != self.strategy.integer:
            raise LayerConfigError(f"{self.name}: a key of type {kind.simpleString()} does not fit {self.strategy.name}")
