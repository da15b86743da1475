"""Shards of near-equal bytes by histogram sort, on DataFrame functions alone.

Rows are ordered by (hash of the text, hash of the id, row number), so equal texts
stand side by side.  The splitters between shards are found without sorting: each
round counts the exact bytes between candidate key boundaries, in one aggregation
over a thin table of keys and sizes, and keeps, for each splitter, the gap in which
its target lies.  A splitter is done when a boundary is within ``tolerance`` of
its target; if a gap has shrunk to one key (copies of one text that are larger
than the tolerance), the next column of the key decides.  Then the rows are
exchanged once, to their shard and a part of it, in which they get their slots.

The bytes of a shard differ from the mean by the tolerance on either side, or by
a row where rows are larger.  Copies stay in one shard, unless a splitter has to
cut their group: a group of at most ``group_slack`` of a shard stays whole.

Size: UTF-8 bytes of the text plus ``overhead``; null and empty texts count as
equal.  Null ids and repeated rows are rows like others (the row number tells
them apart).  An empty table gives no rows.  The columns in ``carry`` are kept
under their names; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procmon.llm.common import written

CELLS = 1024  # gaps that a round counts in each open interval
PART_ROWS = 250_000  # rows of a shard that get their slots together
TOP = (1 << 63) - 1
KEY = ("key_text", "key_id", "key_row")


def _half(c: Column) -> Column:
    """A 64-bit hash as a number from 0 to 2^63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(c), 1)


def split_points(rows: DataFrame, column: str, targets: list[int], tolerance: int, slack: int) -> list[tuple[int, int, bool]]:
    """For each target the boundary x, the bytes of rows with ``column`` <= x, and whether it is within the tolerance.

    A boundary that is not within it is the last one below the key in which the
    target lies: the caller splits that key, x + 1, by another column.
    """
    interval = {t: (-1, TOP, 0) for t in targets}  # boundary below, boundary above, bytes up to the lower one
    done: dict[int, tuple[int, int, bool]] = {}
    while interval:
        gaps = sorted({(lo, hi) for lo, hi, _ in interval.values()})
        number, step = F.lit(None).cast("int"), F.lit(None).cast("long")
        low = F.lit(None).cast("long")
        for i, (lo, hi) in reversed(list(enumerate(gaps))):
            inside = (F.col(column) > lo) & (F.col(column) <= hi)
            number, low = F.when(inside, i).otherwise(number), F.when(inside, F.lit(lo)).otherwise(low)
            step = F.when(inside, F.lit(max(1, -(-(hi - lo) // CELLS)))).otherwise(step)
        placed = rows.select("size", F.col(column), number.alias("gap"), low.alias("low"), step.alias("step")).where("gap is not null")
        cell = F.expr(f"(`{column}` - low - 1) div step")
        counts = placed.groupBy("gap", cell.alias("cell")).agg(F.sum("size").alias("bytes"), F.min(column).alias("least"), F.max(column).alias("most"), F.count("*").alias("rows")).collect()
        by_gap: dict[int, list[tuple]] = {}
        for r in counts:
            by_gap.setdefault(r["gap"], []).append(tuple(r)[1:])
        for t, (lo, hi, below) in list(interval.items()):
            under = below
            for _, b, least, most, n in sorted(by_gap.get(gaps.index((lo, hi)), [])):
                if under + b > t:
                    break
                under += b
            else:  # no row above the target in this gap
                done[t] = (hi, under, True)
                del interval[t]
                continue
            low_side, high_side, one_key = t - under, under + b - t, least == most
            if min(low_side, high_side) <= tolerance or n == 1 or (one_key and b <= slack):
                done[t] = (least - 1, under, True) if low_side <= high_side else (most, under + b, True)
            elif one_key:
                done[t] = (least - 1, under, False)
            else:
                interval[t] = (least - 1, most, under)
                continue
            del interval[t]
    return [done[t] for t in targets]


def splitters(rows: DataFrame, targets: list[int], tolerance: int, slack: int, columns: tuple[str, ...] = KEY) -> list[tuple[int, ...]]:
    """Upper key bounds of the shards but the last: rows up to and including the bound are below the splitter."""
    found = split_points(rows, columns[0], targets, tolerance, slack)
    out: dict[int, tuple[int, ...]] = {}
    inner: dict[int, list[tuple[int, int]]] = {}
    for t, (x, below, close) in zip(targets, found, strict=True):
        if close or len(columns) == 1:
            out[t] = (x, *[TOP] * (len(columns) - 1))
        else:
            inner.setdefault(x + 1, []).append((t, t - below))
    for key, wanted in inner.items():
        for (t, _), rest in zip(wanted, splitters(rows.where(F.col(columns[0]) == key), [w for _, w in wanted], tolerance, tolerance, columns[1:]), strict=True):
            out[t] = (key, *rest)
    return [out[t] for t in targets]


def _above(bound: tuple[int, ...]) -> Column:
    """Whether a row's key lies above a splitter."""
    out = F.col(KEY[-1]) > bound[-1]
    for name, x in reversed(list(zip(KEY[:-1], bound[:-1], strict=True))):
        out = (F.col(name) > x) | ((F.col(name) == x) & out) if x < TOP else F.lit(False)
    return out


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, tolerance: float = 0.001, group_slack: float = 0.02, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, size, text_crc32, shard, slot, *carry) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(
        F.col(id_col).alias("row_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        _half(text).alias(KEY[0]),
        _half(F.concat(F.lit("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias(KEY[1]),
        F.monotonically_increasing_id().alias(KEY[2]),
        *(F.col(c).alias(f"carry_{c}") for c in carry),
    )
    keys = written(keys, "keys")
    total, n = keys.agg(F.sum("size"), F.count("*")).first()
    targets = sorted({(total or 0) * (s + 1) // shards for s in range(shards - 1)})
    bounds = splitters(keys, targets, int((total or 0) / shards * tolerance), int((total or 0) / shards * group_slack)) if n else []
    number = F.lit(0)
    for b in bounds:
        number = number + _above(b).cast("int")
    parts = max(1, -(-n // (shards * PART_ROWS)))
    placed = keys.withColumns({"shard": number.cast("int"), "part": F.pmod(F.xxhash64(KEY[2]), F.lit(parts)).cast("int")})
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("base"))
    order = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*KEY))
    out = placed.withColumn("nth", order - 1).join(base, ["shard", "part"])
    return out.select(F.col("row_id").alias(id_col), "size", "text_crc32", "shard", (F.col("base") + F.col("nth")).alias("slot"), *(F.col(f"carry_{c}").alias(c) for c in carry))
