"""Bucketing (B1–B4) and prefix encoders.

For prefix ``n`` of a case every encoder is a *running* value at event ``n``
(first / last non-null, running aggregates, value of event ``i``, previous
event), so all prefixes of a log are encoded by one window pass over the
un-exploded log: one exchange on the case column and one sort, instead of
materialising ``events x prefix lengths`` rows.  Rows are then kept where
``min_len <= n <= max_len`` and ``n < case length``.

Categorical columns are one-hot encoded against a vocabulary frozen on the
training log: unseen levels give all zeros and the column list never depends
on the data being encoded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procmon.functions import bounded_collect
from procmon.spec import LogSpec, col

# Largest vocabulary kept as literal one-hot columns (wider ones need a sparse encoding).
MAX_LEVELS = 2_000
METHODS = {
    "none": (),
    "static": ("static",),
    "last": ("last",),
    "agg": ("agg",),
    "bool": ("bool",),
    "index": ("index",),
    "previous": ("previous",),
    "laststate": ("static", "last"),
    "aggregate": ("static", "agg"),
    "indexbased": ("static", "index"),
    "combined": ("static", "last", "agg"),
}


# -- bucketing --------------------------------------------------------------


def bucket_zero(df: DataFrame, name: str = "bucket") -> DataFrame:
    """B1: every prefix in one bucket."""
    return df.withColumn(name, F.lit(1))


def bucket_prefix(df: DataFrame, key: str = "prefix_len", name: str = "bucket") -> DataFrame:
    """B2: one bucket per prefix length."""
    return df.withColumn(name, F.col(key).cast("int"))


def fit_states(train: DataFrame, name: str = "bucket") -> DataFrame:
    """The buckets seen in training."""
    return train.select(name).distinct()


# Most known buckets kept as a literal set.
MAX_BUCKETS = 10_000


def apply_fallback(pred: DataFrame, known: DataFrame, pred_col: str, fallback: Column, name: str = "bucket") -> DataFrame:
    """Predictions of buckets unseen in training are replaced by ``fallback``.  The known
    buckets (one row per bucket, size-checked) become a literal set."""
    rows = bounded_collect(known, MAX_BUCKETS)
    if rows is None:
        raise ValueError(f"more than {MAX_BUCKETS} buckets")
    ks = [r[0] for r in rows]
    return pred.withColumn(pred_col, F.when(F.col(name).isin(ks), F.col(pred_col)).otherwise(fallback))


# -- vocabulary ---------------------------------------------------------------


@dataclass(frozen=True)
class Vocab:
    levels: dict  # column -> tuple of levels (sorted)

    def __getitem__(self, c: str) -> tuple:
        return self.levels.get(c, ())


def fit_vocab(train: DataFrame, cols, max_levels: int = MAX_LEVELS) -> Vocab:
    """E8 (fit): distinct non-null levels per categorical column of the training log, one pass."""
    cols = list(dict.fromkeys(cols))
    if not cols:
        return Vocab({})
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), col(c).cast("string").alias("v")) for c in cols]))
    levels = train.select(pairs.alias("p")).select("p.c", "p.v").where(F.col("v").isNotNull()).distinct()
    bound = max_levels * len(cols)
    rows = bounded_collect(levels, bound)  # size-checked
    if rows is None:
        raise ValueError(f"more than {bound} levels in {cols}: reduce with topk_to_other / rare_to_other first")
    out: dict[str, list] = {c: [] for c in cols}
    for r in rows:
        out[r["c"]].append(r["v"])
    return Vocab({c: tuple(sorted(v)) for c, v in out.items()})


def one_hot(value: Column, levels, prefix: str) -> dict[str, Column]:
    """E8 (apply): ``{prefix}_{level}`` = 1.0 where ``value == level`` (unseen / null -> 0)."""
    return {f"{prefix}_{lv}": F.coalesce((value == F.lit(lv)).cast("double"), F.lit(0.0)) for lv in levels}


# -- encoders -------------------------------------------------------------------


def _num(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))  # E9: undefined -> 0


def _static_cols(spec: LogSpec, vocab: Vocab, wr) -> dict[str, Column]:
    """First non-null value in the prefix."""
    out = {}
    for c in spec.static_num:
        out[f"static__{c}"] = _num(F.first(col(c), ignorenulls=True).over(wr))
    for c in spec.static_cat:
        out.update(one_hot(F.first(col(c), ignorenulls=True).over(wr), vocab[c], f"static__{c}"))
    return out


def _last_cols(spec: LogSpec, vocab: Vocab, wr) -> dict[str, Column]:
    """Last non-null value in the prefix."""
    out = {}
    for c in spec.dynamic_num:
        out[f"last__{c}"] = _num(F.last(col(c), ignorenulls=True).over(wr))
    for c in spec.dynamic_cat:
        out.update(one_hot(F.last(col(c), ignorenulls=True).over(wr), vocab[c], f"last__{c}"))
    return out


def _agg_cols(spec: LogSpec, vocab: Vocab, wr, boolean: bool) -> dict[str, Column]:
    """Running mean, max, min, sum, sample std of numbers; count (or presence) of levels."""
    tag = "bool" if boolean else "agg"
    out = {}
    for c in spec.dynamic_num:
        x = col(c).cast("double")
        out[f"{tag}__mean_{c}"] = _num(F.avg(x).over(wr))
        out[f"{tag}__max_{c}"] = _num(F.max(x).over(wr))
        out[f"{tag}__min_{c}"] = _num(F.min(x).over(wr))
        out[f"{tag}__sum_{c}"] = _num(F.sum(x).over(wr))
        out[f"{tag}__std_{c}"] = _num(F.stddev_samp(x).over(wr))
    for c in spec.dynamic_cat:
        for lv in vocab[c]:
            hit = F.when(col(c) == F.lit(lv), F.lit(1.0)).otherwise(F.lit(0.0))
            out[f"{tag}__{c}_{lv}"] = (F.max(hit) if boolean else F.sum(hit)).over(wr)
    return out


def _index_cols(spec: LogSpec, vocab: Vocab, wr, max_events: int) -> dict[str, Column]:
    """E5: attributes of event ``i`` (0-based) as ``{col}_{i}``; events beyond the prefix -> 0."""
    out = {}
    for i in range(max_events):
        for c in spec.dynamic_num:
            out[f"index__{c}_{i}"] = _num(F.nth_value(col(c), i + 1).over(wr))
        for c in spec.dynamic_cat:
            out.update(one_hot(F.nth_value(col(c), i + 1).over(wr), vocab[c], f"index__{c}_{i}"))
    return out


def _previous_cols(spec: LogSpec, vocab: Vocab, w) -> dict[str, Column]:
    """Attributes of the second-to-last event of the prefix (nulls kept; none -> 0)."""
    out = {}
    for c in spec.dynamic_num:
        out[f"previous__{c}"] = _num(F.lag(col(c), 1).over(w))
    for c in spec.dynamic_cat:
        out.update(one_hot(F.lag(col(c), 1).over(w), vocab[c], f"previous__{c}"))
    return out


def feature_columns(spec: LogSpec, vocab: Vocab, method: str, max_events: int = 0) -> dict[str, Column]:
    """The feature columns of ``method`` (a union of encoders), in a fixed order."""
    w, wr = spec.window(), spec.running()
    out: dict[str, Column] = {}
    for part in METHODS[method]:
        if part == "static":
            out.update(_static_cols(spec, vocab, wr))
        elif part == "last":
            out.update(_last_cols(spec, vocab, wr))
        elif part == "agg":
            out.update(_agg_cols(spec, vocab, wr, boolean=False))
        elif part == "bool":
            out.update(_agg_cols(spec, vocab, wr, boolean=True))
        elif part == "index":
            out.update(_index_cols(spec, vocab, wr, max_events))
        elif part == "previous":
            out.update(_previous_cols(spec, vocab, w))
    return out


def index_positions(method: str, max_events: int | None, max_len: int | None) -> int:
    """The event positions of an index encoding; an error if neither argument names them."""
    known = max_events or max_len or 0
    if "index" in METHODS[method] and not known:
        raise ValueError("an index encoding needs max_events (flow.index_events counts them) or max_len")
    return known


def encode(
    df: DataFrame,
    spec: LogSpec,
    vocab: Vocab,
    method: str = "combined",
    min_len: int = 1,
    max_len: int | None = None,
    max_events: int | None = None,
    keep=(),
    key: str = "prefix_len",
    strict: bool = True,
    hot: DataFrame | None = None,
) -> DataFrame:
    """One row per prefix ``(case, prefix_len)`` with the features of ``method``.

    ``keep`` names event columns carried along (e.g. ``remtime``: its value at the
    last event of the prefix is the prefix's regression label, L10).  ``strict=False``
    also encodes the whole trace (running cases, R1).  ``hot`` (from
    ``segmented.hot_cases``) lists cases too large for one window task; they are
    encoded in segments with the same result."""
    if hot is not None:
        from procmon.operators.segmented import encode_segmented

        return encode_segmented(df, spec, vocab, method, min_len, max_len, max_events, keep, key, strict, hot=hot)
    w = spec.window()
    max_events = index_positions(method, max_events, max_len)
    feats = feature_columns(spec, vocab, method, max_events)
    nr = F.row_number().over(w)
    length = F.count(F.lit(1)).over(Window.partitionBy(col(spec.case)))
    x = df.select(
        col(spec.case).alias(spec.case),
        nr.alias(key),
        length.alias("_len"),
        *[col(k).alias(k) for k in keep],
        *[c.alias(n) for n, c in feats.items()],
    )
    cond = (F.col(key) >= min_len) & ((F.col(key) < F.col("_len")) if strict else (F.col(key) <= F.col("_len")))
    if max_len is not None:
        cond = cond & (F.col(key) <= max_len)
    return x.where(cond).withColumnRenamed("_len", "_case_len") if not strict else x.where(cond).drop("_len")


def select_index(df: DataFrame, spec: LogSpec, vocab: Vocab, max_events: int, id_cols=("case_id", "prefix_len")) -> DataFrame:
    """The ``index`` columns for ``max_events`` events, missing ones added as 0."""
    names = []
    for i in range(max_events):
        names += [f"index__{c}_{i}" for c in spec.dynamic_num]
        names += [f"index__{c}_{i}_{lv}" for c in spec.dynamic_cat for lv in vocab[c]]
    have = set(df.columns)
    return df.select(*[F.col(c) for c in id_cols], *[F.col(f"`{n}`") if n in have else F.lit(0.0).alias(n) for n in names])


def fill_features(df: DataFrame, exclude=()) -> DataFrame:
    """Nulls in numeric feature columns -> 0."""
    num = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long") and f.name not in exclude]
    return df.na.fill(0, subset=num)


def feature_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "__" in c]
