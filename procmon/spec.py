"""Column roles of an event log (the per-dataset parameters of the reference)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """Column reference that tolerates dots and spaces in names (``CostCenter.Code``)."""
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class LogSpec:
    """Roles of the columns of an event log.

    ``tiebreak`` must make ``(case, ts, tiebreak)`` a total order of the events
    of a case; prefixes are the first n events in that order.
    """

    case: str
    activity: str
    ts: str
    tiebreak: str
    static_cat: tuple[str, ...] = ()
    static_num: tuple[str, ...] = ()
    dynamic_cat: tuple[str, ...] = ()
    dynamic_num: tuple[str, ...] = ()
    labels: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        # label names are never features
        for role in ("static_cat", "static_num", "dynamic_cat", "dynamic_num"):
            cols = tuple(c for c in getattr(self, role) if c not in self.labels)
            object.__setattr__(self, role, cols)

    # -- windows -------------------------------------------------------
    def order(self) -> list[Column]:
        return [col(self.ts).asc(), col(self.tiebreak).asc()]

    def window(self):
        """``W``: events of a case in log order."""
        return Window.partitionBy(col(self.case)).orderBy(*self.order())

    def running(self):
        """``Wr``: from the first event of the case up to the current one."""
        return self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def whole_case(self):
        return Window.partitionBy(col(self.case))

    # -- schema --------------------------------------------------------
    @property
    def cat_cols(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(self.dynamic_cat + self.static_cat))

    @property
    def num_cols(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(self.dynamic_num + self.static_num))

    def to_struct(self, tiebreak_type: T.DataType = T.LongType()) -> T.StructType:
        """Typed schema: ids and categories string, numbers double, ts timestamp_ntz."""
        fields = [
            T.StructField(self.case, T.StringType()),
            T.StructField(self.activity, T.StringType()),
            T.StructField(self.ts, T.TimestampNTZType()),
        ]
        seen = {self.case, self.activity, self.ts}
        if self.tiebreak not in seen:
            fields.append(T.StructField(self.tiebreak, tiebreak_type))
            seen.add(self.tiebreak)
        for c in self.cat_cols:
            if c not in seen:
                fields.append(T.StructField(c, T.StringType()))
                seen.add(c)
        for c in self.num_cols:
            if c not in seen:
                fields.append(T.StructField(c, T.DoubleType()))
                seen.add(c)
        return T.StructType(fields)

    def with_(self, **kw) -> "LogSpec":
        return replace(self, **kw)
