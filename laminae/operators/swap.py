"""Replacing the source of a layer, verified first.

Shape checks gate row checks. Every row check is a query whose rows are the problem; a finding
carries their number. ``cutover`` runs the checks again on the version it replaces and publishes by
compare-and-swap; the old source is never touched, so a swap back is a swap.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SwapRefused
from ..functions.predicates import any_distinct
from ..spec import LayerSpec, Relation
from . import integrity
from .layer import LayeredTable


@dataclass(frozen=True)
class Finding:
    code: str
    level: str
    message: str
    count: int = 0

    def __str__(self) -> str:
        return f"{self.code} {self.level}: {self.message}"


@dataclass
class SwapReport:
    findings: list[Finding] = field(default_factory=list)

    def add(self, code: str, level: str, message: str, count: int = 0) -> None:
        self.findings.append(Finding(code, level, message, count))

    @property
    def ok(self) -> bool:
        return not any(f.level == "error" for f in self.findings)

    @property
    def codes(self) -> list[str]:
        return [f.code for f in self.findings]

    def allowing(self, codes: tuple[str, ...]) -> SwapReport:
        """The report with some errors taken as warnings; they stay in it."""
        return SwapReport([replace(f, level="warning") if f.code in codes and f.level == "error" else f for f in self.findings])


# -- row checks, as queries


def reassigned(current: DataFrame, candidate: DataFrame, id_column: str, identity: list[str]) -> DataFrame:
    """Ids that stand for another natural key in the candidate."""
    theirs = candidate.select(F.col(id_column).alias("__id"), *(F.col(c).alias(f"__n_{c}") for c in identity))
    both = current.join(theirs, F.col(id_column) == F.col("__id"))
    return both.filter(any_distinct((F.col(c), F.col(f"__n_{c}")) for c in identity)).select(id_column)


def renumbered(current: DataFrame, candidate: DataFrame, id_column: str, identity: list[str]) -> DataFrame:
    """Natural keys, without nulls, that have another id in the candidate."""
    theirs = candidate.select(F.col(id_column).alias("__id"), *(F.col(c).alias(f"__n_{c}") for c in identity))
    both = current.join(theirs, [F.col(c) == F.col(f"__n_{c}") for c in identity])
    return both.filter(F.col(id_column) != F.col("__id")).select(id_column, F.col("__id").alias("new_id"))


def orphaned(layer: LayeredTable, candidate: LayeredTable) -> DataFrame:
    """Base rows with a row of the current source behind them and none of the candidate."""
    pk = layer.spec.pk
    now = layer.mapped_source().select(F.col(pk).alias("__now"))
    then = candidate.mapped_source().select(F.col(pk).alias("__then"))
    backed = layer.base.join(now, F.col(pk) == F.col("__now"), "left_semi")
    return backed.join(then, F.col(pk) == F.col("__then"), "left_anti").select(pk)


# -- the report


def _n(rows: DataFrame) -> int:
    return rows.count()


def verify(
    layer: LayeredTable,
    candidate: DataFrame | None,
    *,
    identity: list[str] | None = None,
    inbound: list[tuple[Relation, DataFrame]] = (),
    min_row_ratio: float = 0.9,
    partition_columns: list[str] | None = None,
) -> SwapReport:
    """Compare ``candidate`` with the layer's source. ``inbound`` are the relations to the layer with their rows."""
    spec, report = layer.spec, SwapReport()
    if candidate is None:
        report.add("S001", "error", f"{spec.name}: there is no such source")
        return report
    if identity is None:
        report.add("S005", "warning", "no identity columns: reassigned and renumbered ids go unnoticed")
    elif unknown := [c for c in identity if c not in spec.columns]:
        report.add("S016", "error", f"unknown identity columns {unknown}")
    for column in spec.columns:
        named = spec.source.id_column if column == spec.pk else column
        want = layer.base.schema[column].dataType
        if named not in candidate.columns:
            report.add("S002", "error", f"column {named} is missing")
        elif candidate.schema[named].dataType != want:
            report.add("S002", "error", f"column {named} is {candidate.schema[named].dataType.simpleString()}, not {want.simpleString()}")
    if spec.source.extra_where:
        try:
            candidate.filter(F.expr(spec.source.extra_where)).schema  # noqa: B018
        except AnalysisException as e:
            report.add("S014", "error", f"extra_where does not resolve: {str(e).splitlines()[0]}")
    key = spec.source.partition_key
    if key is not None and partition_columns is not None and key not in partition_columns:
        report.add("S012", "warning", f"declared partition key {key}; the candidate is partitioned by {partition_columns}")
    if not report.ok:
        report.add("S000", "warning", "row checks were skipped")
        return report
    then = LayeredTable(spec, layer.base, candidate)
    now_rows, then_rows = _n(layer.source()), _n(then.source())
    if then_rows == 0:
        report.add("S013", "error", "the candidate is empty")
    elif then_rows < min_row_ratio * now_rows:
        report.add("S013", "warning", f"{then_rows} rows instead of {now_rows}", then_rows)
    if identity:
        ids = [c if c != spec.pk else spec.source.id_column for c in identity]
        if n := _n(reassigned(layer.source(), then.source(), spec.source.id_column, ids)):
            report.add("S003", "error", f"{n} ids stand for another row", n)
        if n := _n(renumbered(layer.source(), then.source(), spec.source.id_column, ids)):
            report.add("S004", "error", f"{n} rows have another id", n)
    if n := _n(orphaned(layer, then)):
        report.add("S006", "warning", f"{n} base rows lose their source row", n)
    for relation, refs in inbound:
        now = _n(integrity.dangling(refs, relation.column, layer.rows(), spec.pk))
        dangling = _n(integrity.dangling(refs, relation.column, then.rows(), spec.pk))
        if dangling:
            level = "error" if dangling > now else "warning"
            report.add("S007", level, f"{relation.from_table}.{relation.column}: {dangling} rows name nothing, {now} today", dangling)
    for unique in spec.unique:
        now, twice = (_n(integrity.source_duplicates(x.mapped_source(), unique)) for x in (layer, then))
        if twice:
            report.add("S008", "error" if twice > now else "warning", f"{unique.columns}: {twice} values occur twice, {now} today", twice)
        if n := _n(integrity.source_collisions(then, unique)):
            report.add("S009", "error", f"{unique.columns}: {n} values are held by base rows", n)
    return report


def cutover(store, spec: LayerSpec, candidate: str, read: Callable[[str], DataFrame | None], *, allow: tuple[str, ...] = (), dry_run: bool = False, **checks) -> SwapReport:
    """Point the layer of ``store`` at the source named ``candidate``.

    What is deployed is read from the manifest, not from configuration. The manifest is replaced by
    compare-and-swap on the version that was checked, so a base that changes meanwhile is an error.
    """
    version = store.version()
    manifest = store.manifest(version)
    deployed = manifest.get("source")
    if deployed is None:
        report = SwapReport([Finding("S017", "error", "the manifest does not say which source is deployed")])
        raise SwapRefused(report)
    if deployed == candidate:
        return SwapReport([Finding("S018", "warning", f"{candidate} is deployed already")])
    layer = LayeredTable(spec, store.read(version), read(deployed))
    report = verify(layer, read(candidate), **checks).allowing(allow)
    if not report.ok:
        raise SwapRefused(report)
    if not dry_run:
        store.swap(version, source=candidate)
    return report
