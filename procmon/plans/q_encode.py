"""Queries B1–B4 and E1–E10 on EL1 with blanked values (null rules of FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import functions as F

from procmon.operators import encode as E
from procmon.operators import features as T
from procmon.operators import sparse as S
from procmon.operators import split as D
from procmon.plans.fixtures import EL1, EL1N, EL1N_SQL, el1, with_
from procmon.plans.registry import register, sql_unit

# roles used by the encoder queries (small fixed vocabularies)
ENC = EL1.with_(static_cat=("segment_n",), static_num=("acctbal",), dynamic_cat=("activity",), dynamic_num=("value_n",))
ACTS = ("click", "error", "purchase", "signup", "view")
SEGS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
ROUNDED = ("mean", "sum", "std")
_W = "PARTITION BY case_id ORDER BY ts, event_id"
_WR = f"({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _vocab(spark, d):
    return E.fit_vocab(el1(spark, d, nulls=True), ENC.cat_cols)


def _sql_parts(part: str, max_events: int) -> list[str]:
    z = "0.0"
    cols = []
    if part == "static":
        cols.append(f"CAST(coalesce(first_value(acctbal IGNORE NULLS) OVER {_WR}, {z}) AS DOUBLE) AS static__acctbal")
        cols += [
            f"CAST(coalesce(first_value(segment_n IGNORE NULLS) OVER {_WR} = '{s}', false) AS DOUBLE) AS static__segment_n_{s}"
            for s in SEGS
        ]
    elif part == "last":
        cols.append(f"CAST(coalesce(last_value(value_n IGNORE NULLS) OVER {_WR}, {z}) AS DOUBLE) AS last__value_n")
        cols += [
            f"CAST(coalesce(last_value(activity IGNORE NULLS) OVER {_WR} = '{a}', false) AS DOUBLE) AS last__activity_{a}" for a in ACTS
        ]
    elif part in ("agg", "bool"):
        for fn, name in (("avg", "mean"), ("max", "max"), ("min", "min"), ("sum", "sum"), ("stddev_samp", "std")):
            e = f"coalesce({fn}(value_n) OVER {_WR}, {z})"
            if name in ROUNDED:
                e = f"round({e}, 6)"
            cols.append(f"CAST({e} AS DOUBLE) AS {part}__{name}_value_n")
        fn = "max" if part == "bool" else "sum"
        cols += [
            f"CAST({fn}(CASE WHEN activity = '{a}' THEN 1.0 ELSE 0.0 END) OVER {_WR} AS DOUBLE) AS {part}__activity_{a}" for a in ACTS
        ]
    elif part == "index":
        for i in range(max_events):
            cols.append(f"CAST(coalesce(nth_value(value_n, {i + 1}) OVER {_WR}, {z}) AS DOUBLE) AS index__value_n_{i}")
            cols += [
                f"CAST(coalesce(nth_value(activity, {i + 1}) OVER {_WR} = '{a}', false) AS DOUBLE) AS index__activity_{i}_{a}"
                for a in ACTS
            ]
    elif part == "previous":
        cols.append(f"CAST(coalesce(lag(value_n) OVER ({_W}), {z}) AS DOUBLE) AS previous__value_n")
        cols += [f"CAST(coalesce(lag(activity) OVER ({_W}) = '{a}', false) AS DOUBLE) AS previous__activity_{a}" for a in ACTS]
    return cols


def encode_sql(method: str, lo: int, hi: int | None, max_events: int = 0, extra: str = "") -> str:
    cols = [c for part in E.METHODS[method] for c in _sql_parts(part, max_events)]
    return (
        with_(EL1N_SQL)
        + f", enc AS (SELECT case_id, CAST(row_number() OVER ({_W}) AS INTEGER) AS prefix_len, count(*) OVER (PARTITION BY case_id) AS len"
        + extra
        + ", "
        + ", ".join(cols)
        + f" FROM el1n) SELECT * EXCLUDE (len) FROM enc WHERE prefix_len >= {lo} AND prefix_len < len"
        + ("" if hi is None else f" AND prefix_len <= {hi}")
    )


def _encoded(spark, d, method, lo, hi, max_events=None, keep=()):
    df = el1(spark, d, nulls=True)
    out = E.encode(df, ENC, _vocab(spark, d), method, lo, hi, max_events=max_events, keep=keep)
    rounded = {c: F.round(c, 6) for c in out.columns if any(c.startswith(f"{p}__{r}_") for p in ("agg", "bool") for r in ROUNDED)}
    return out.withColumns(rounded)


def _reg_encoder(key: str, method: str, lo: int, hi: int | None = None, max_events: int = 0):
    @register(key, encode_sql(method, lo, hi, max_events))
    def q(spark, d):
        return _encoded(spark, d, method, lo, hi, max_events)

    return q


_reg_encoder("e1_encode_static", "static", 2)
_reg_encoder("e2_encode_last", "last", 2)
_reg_encoder("e3_encode_agg", "agg", 2)
_reg_encoder("e4_encode_bool", "bool", 2)
_reg_encoder("e5_encode_index", "index", 1, None, 6)
_reg_encoder("e7_encode_previous", "previous", 1)
_reg_encoder("e10_encode_combined", "combined", 2)
_reg_encoder("e10b_encode_laststate", "laststate", 2)
_reg_encoder("e10c_encode_indexbased", "indexbased", 2, None, 4)


@register(
    "e6_select_index",
    encode_sql("index", 2, None, 3).replace("SELECT * EXCLUDE (len) FROM enc", "SELECT case_id, prefix_len, "
    + ", ".join([f"index__value_n_{i}" if i < 3 else f"CAST(0 AS DOUBLE) AS index__value_n_{i}" for i in range(5)])
    + ", " + ", ".join([f"index__activity_{i}_{a}" if i < 3 else f"CAST(0 AS DOUBLE) AS index__activity_{i}_{a}" for i in range(5) for a in ACTS])
    + " FROM enc"),
)
def e6(spark, d):
    enc = _encoded(spark, d, "index", 2, None, 3)
    return E.select_index(enc, ENC, _vocab(spark, d), 5)


@register(
    "e8_one_hot",
    with_(
        EL1N_SQL,
        "cs AS (SELECT case_id, min(ts) AS s FROM el1n GROUP BY case_id)",
        "rk AS (SELECT case_id, row_number() OVER (ORDER BY s, case_id) AS rn, count(*) OVER () AS n FROM cs)",
        "tr AS (SELECT e.* FROM el1n e JOIN rk ON e.case_id = rk.case_id WHERE rk.rn <= ceil(0.5 * rk.n))",
        "te AS (SELECT e.* FROM el1n e JOIN rk ON e.case_id = rk.case_id WHERE rk.rn > ceil(0.5 * rk.n))",
        "voc AS (SELECT DISTINCT k FROM tr WHERE k IS NOT NULL)",
    )
    + "SELECT te.case_id, te.event_id, 'k_' || voc.k AS feature, CAST(te.k = voc.k AS DOUBLE) AS value FROM te, voc",
)
def e8(spark, d):
    df = el1(spark, d, nulls=True)
    train, test = D.temporal_split(df, EL1, 0.5)
    vocab = E.fit_vocab(train, ["k"])
    wide = test.select("case_id", "event_id", *[c.alias(n) for n, c in E.one_hot(F.col("k"), vocab["k"], "k").items()])
    names = [f"k_{lv}" for lv in vocab["k"]]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("value")) for n in names]))
    return wide.select("case_id", "event_id", pairs.alias("p")).select("case_id", "event_id", "p.feature", "p.value")


@register("e9_fill_features", with_(EL1N_SQL) + "SELECT case_id, event_id, coalesce(value_n, 0.0) AS value_n FROM el1n")
def e9(spark, d):
    return E.fill_features(el1(spark, d, nulls=True).select("case_id", "event_id", "value_n"), exclude=("event_id",))


_PFX = f", CAST(row_number() OVER ({_W}) AS INTEGER) AS prefix_len, count(*) OVER (PARTITION BY case_id) AS len"


@register(
    "b1_bucket_zero",
    with_(EL1N_SQL) + f"SELECT case_id, prefix_len, 1 AS bucket FROM (SELECT case_id {_PFX} FROM el1n) WHERE prefix_len >= 2 AND prefix_len < len",
)
def b1(spark, d):
    return E.bucket_zero(_encoded(spark, d, "last", 2, None)).select("case_id", "prefix_len", "bucket")


@register(
    "b2_bucket_prefix",
    with_(EL1N_SQL)
    + f"SELECT case_id, prefix_len, prefix_len AS bucket FROM (SELECT case_id {_PFX} FROM el1n) WHERE prefix_len >= 2 AND prefix_len < len",
)
def b2(spark, d):
    return E.bucket_prefix(_encoded(spark, d, "last", 2, None)).select("case_id", "prefix_len", "bucket")


@register(
    "b3_fit_states",
    with_(EL1N_SQL) + f"SELECT DISTINCT prefix_len AS bucket FROM (SELECT case_id {_PFX} FROM el1n) WHERE prefix_len >= 2 AND prefix_len < len",
)
def b3(spark, d):
    return E.fit_states(E.bucket_prefix(_encoded(spark, d, "last", 2, None)))


_B4_SQL = with_(
    EL1N_SQL,
    "cs AS (SELECT case_id, min(ts) AS s FROM el1n GROUP BY case_id)",
    "rk AS (SELECT case_id, row_number() OVER (ORDER BY s, case_id) AS rn, count(*) OVER () AS n FROM cs)",
    "ev AS (SELECT e.*, rk.rn <= ceil(0.8 * rk.n) AS is_train, "
    + sql_unit("epoch_us(max(ts) OVER (PARTITION BY e.case_id)) - epoch_us(ts)", "s")
    + f" AS remtime {_PFX.replace('case_id', 'e.case_id')} FROM el1n e JOIN rk ON e.case_id = rk.case_id)",
    "trp AS (SELECT * FROM ev WHERE is_train AND prefix_len BETWEEN 2 AND 4 AND prefix_len < len)",
    "tep AS (SELECT * FROM ev WHERE NOT is_train AND prefix_len >= 2 AND prefix_len < len)",
    "bm AS (SELECT prefix_len AS bucket, avg(remtime) AS pred FROM trp GROUP BY prefix_len)",
) + (
    "SELECT tep.case_id, tep.prefix_len, tep.prefix_len AS bucket, round(coalesce(bm.pred, (SELECT avg(remtime) FROM trp)), 3) AS pred "
    "FROM tep LEFT JOIN bm ON tep.prefix_len = bm.bucket"
)


@register("b4_apply_fallback", _B4_SQL)
def b4(spark, d):
    df = T.remaining_time(el1(spark, d, nulls=True), EL1)
    train, test = D.temporal_split(df, EL1, 0.8)
    vocab = _vocab(spark, d)
    trp = E.bucket_prefix(E.encode(train, ENC, vocab, "last", 2, 4, keep=("remtime",)))
    tep = E.bucket_prefix(E.encode(test, ENC, vocab, "last", 2, None, keep=("remtime",)))
    known = E.fit_states(trp)
    per_bucket = trp.groupBy("bucket").agg(F.avg("remtime").alias("pred"))
    overall = trp.agg(F.avg("remtime").alias("_m"))
    pred = tep.join(per_bucket, "bucket", "left")
    fallback = F.lit(overall.first()["_m"])
    out = E.apply_fallback(pred, known, "pred", fallback)
    return out.select("case_id", "prefix_len", "bucket", F.round("pred", 3).alias("pred"))


@register("e10d_encode_combined_segmented", encode_sql("combined", 2, None))
def e10d(spark, d):
    """E10 with every case above 3 events split into time segments (the hot-case path)."""
    from procmon.operators.segmented import encode_segmented

    out = encode_segmented(el1(spark, d, nulls=True), ENC, _vocab(spark, d), "combined", 2, None, max_rows=3)
    rounded = {c: F.round(c, 6) for c in out.columns if any(c.startswith(f"agg__{r}_") for r in ROUNDED)}
    return out.withColumns(rounded)


# -- sparse encodings: every level of `k` and `nation`, every position ---------------

_X = f"x AS (SELECT *, CAST(row_number() OVER ({_W}) AS INTEGER) AS pos, count(*) OVER (PARTITION BY case_id) AS len FROM el1n)"
_UPTO = "x p JOIN x e ON p.case_id = e.case_id AND e.pos <= p.pos"


def _sparse_sql(part: str) -> list[str]:
    """Selects of (case_id, prefix_len, feature, value, len), one for each column of an encoder."""
    head = "SELECT case_id, pos AS prefix_len, "
    own = {"static": ("first_value", EL1N.static_cat, EL1N.static_num), "last": ("last_value", EL1N.dynamic_cat, EL1N.dynamic_num)}
    out = []
    if part in own:
        fn, cat, num = own[part]
        out += [head + f"'{part}__{c}=' || {fn}({c} IGNORE NULLS) OVER {_WR} AS feature, 1.0 AS value, len FROM x" for c in cat]
        out += [head + f"'{part}__{c}' AS feature, {fn}({c} IGNORE NULLS) OVER {_WR} AS value, len FROM x" for c in num]
    elif part == "agg":
        for c in EL1N.dynamic_cat:
            out.append(f"SELECT p.case_id, p.pos, '{part}__{c}=' || e.{c}, count(*), p.len FROM {_UPTO} WHERE e.{c} IS NOT NULL GROUP BY ALL")
        for c in EL1N.dynamic_num:
            for fn, name in (("avg", "mean"), ("max", "max"), ("min", "min"), ("sum", "sum"), ("stddev_samp", "std")):
                out.append(head + f"'{part}__{name}_{c}' AS feature, {fn}({c}) OVER {_WR} AS value, len FROM x")
    elif part == "index":
        at = f"'[' || (e.pos - 1) || ']"
        out += [f"SELECT p.case_id, p.pos, '{part}__{c}' || {at}=' || e.{c}, 1.0, p.len FROM {_UPTO}" for c in EL1N.dynamic_cat]
        out += [f"SELECT p.case_id, p.pos, '{part}__{c}' || {at}', e.{c}, p.len FROM {_UPTO}" for c in EL1N.dynamic_num]
    return out


def sparse_sql(method: str, lo: int, where: str = "true", ctes=()) -> str:
    """The encoding in long form: entries other than 0 of the prefixes of ``lo`` or more events."""
    rows = " UNION ALL ".join(f"({q})" for part in E.METHODS[method] for q in _sparse_sql(part))
    store = f"store(case_id, prefix_len, feature, value, len) AS ({rows})"
    return (
        with_(EL1N_SQL, _X, store, *ctes)
        + "SELECT case_id, prefix_len, feature, round(CAST(value AS DOUBLE), 6) AS value FROM store "
        + f"WHERE prefix_len >= {lo} AND prefix_len < len AND feature IS NOT NULL AND round(CAST(value AS DOUBLE), 6) <> 0 AND {where}"
    )


def _long(entries):
    return entries.select("case_id", "prefix_len", "feature", F.round("value", 6).alias("value")).where("value <> 0")


def _split_ctes(lo: int) -> tuple[str, ...]:
    return (
        "cs AS (SELECT case_id, min(ts) AS s FROM el1n GROUP BY case_id)",
        "rk AS (SELECT case_id, row_number() OVER (ORDER BY s, case_id) AS rn, count(*) OVER () AS n FROM cs)",
        "early AS (SELECT case_id FROM rk WHERE rn <= ceil(0.8 * n))",
        f"known AS (SELECT DISTINCT feature FROM store WHERE prefix_len >= {lo} AND prefix_len < len AND value <> 0 AND case_id IN (SELECT case_id FROM early))",
    )


_TEST = "case_id NOT IN (SELECT case_id FROM early) AND feature IN (SELECT feature FROM known)"


@register("e5b_index_all_positions", sparse_sql("index", 1))
def e5b(spark, d):
    """E5 with the features of every event position and every level of `k`."""
    return _long(S.expand(S.spans(el1(spark, d, nulls=True), EL1N, "index")))


@register(
    "e6b_select_index_to_quantile",
    sparse_sql(
        "index",
        1,
        "CAST(regexp_extract(feature, '\\[([0-9]+)\\]', 1) AS INTEGER) < (SELECT q FROM top)",
        ("top AS (SELECT ceil(quantile_cont(n, 0.9)) AS q FROM (SELECT count(*) AS n FROM el1n GROUP BY case_id))",),
    ),
)
def e6b(spark, d):
    """The positions below the 0.9-quantile of case lengths."""
    df = el1(spark, d, nulls=True)
    return _long(S.expand(S.below(S.spans(df, EL1N, "index"), D.length_quantile(df, EL1N, 0.9))))


@register("e8b_frozen_vocabulary", sparse_sql("laststate", 2, _TEST, _split_ctes(2)))
def e8b(spark, d):
    """Features of the test cases by the vocabulary of the training cases, without a row for each event and level."""
    train, test = D.temporal_split(el1(spark, d, nulls=True), EL1N, 0.8)
    vocab = S.fit_features(S.spans(train, EL1N, "laststate", 2))
    return _long(S.expand(S.coded(S.spans(test, EL1N, "laststate", 2), vocab)))


@register("e10e_sparse_combined", sparse_sql("combined", 2))
def e10e(spark, d):
    return _long(S.expand(S.spans(el1(spark, d, nulls=True), EL1N, "combined", 2)))


@register("e10f_sparse_vectors", sparse_sql("indexbased", 2, _TEST, _split_ctes(2)))
def e10f(spark, d):
    """The entries of the test cases' vectors over the training vocabulary."""
    train, test = D.temporal_split(el1(spark, d, nulls=True), EL1N, 0.8)
    vocab = S.fit_features(S.spans(train, EL1N, "indexbased", 2))
    return _long(S.entries(S.prefixes(test, EL1N, 2), S.spans(test, EL1N, "indexbased", 2), vocab, EL1N))
