"""What the engine raises."""


class LayerConfigError(ValueError):
    """A declaration or a call that the engine refuses."""


class NotOverridable(RuntimeError):
    """A change to a source row of a layer whose source rows cannot be edited."""


class RedundantUpdate(RuntimeError):
    """An update that changes nothing, under the policy ``raise``."""


class MultipleRows(RuntimeError):
    """Values that should name one row of a view name several."""


class IntegrityViolation(RuntimeError):
    """Rows that break a constraint; ``kind`` is ``foreign key``, ``unique``, ``primary key`` or ``check``."""

    def __init__(self, kind: str, what: str, rows: list) -> None:
        super().__init__(f"{kind}: {what}: {rows[:5]}")
        self.kind, self.rows = kind, rows


class SwapRefused(RuntimeError):
    """A source swap whose report holds errors."""

    def __init__(self, report) -> None:
        super().__init__("\n".join(str(f) for f in report.findings if f.level == "error"))
        self.report = report
