"""Flow-analysis composition and direct prediction.

The remaining time of a running case is either predicted directly (F6) or
composed (F5): per-activity cycle times and per-gateway branch probabilities
are predicted for every test prefix, and each prefix's formula over those
terms is evaluated as a compiled Spark expression (no Python per row).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmon.functions import bounded_collect
from procmon.functions.formula import POSTFIX, FormulaError, compile_formula, evaluate_postfix, identifiers, parse, postfix, term_column
from procmon.functions.rules import RuleSet
from procmon.operators import calibration as K
from procmon.operators import encode as E
from procmon.operators import ensemble as EN
from procmon.operators import features as T
from procmon.operators import models as M
from procmon.operators import split as D
from procmon.operators import targets as L
from procmon.session import checkpoint_dir
from procmon.spec import LogSpec, col

# Most distinct formulas compiled into one CASE expression.
MAX_FORMULAS = 2_000
ID = ("case_id", "prefix_len")
CASE_START = "_case_start"  # of targets, where models are calibrated


def term_names(rs: RuleSet, exits: dict, k0: int = 1) -> tuple[list[str], dict]:
    """Term order: activities, then ``p{k}`` for every exit of every gateway in rule-set order,
    numbered from ``k0``.  Returns the names and ``{(gateway, cls): p-name}``."""
    names = list(rs.activities)
    pmap, k = {}, k0
    for g in rs.gateways:
        for c in M.class_list(exits.get(g, 0)):
            pmap[(g, c)] = f"p{k}"
            names.append(f"p{k}")
            k += 1
    return names, pmap


def term_table(prefixes: DataFrame, preds: list[DataFrame], rs: RuleSet, exits: dict, k0: int = 1, id_cols=ID) -> DataFrame:
    """one row per prefix, a ``t_<activity>`` column per cycle time and ``t_p{k}`` per exit.
    ``preds`` hold ``pred_<activity>`` / ``p_<gateway>_<c>`` columns keyed by ``id_cols``."""
    out = prefixes.select(*id_cols)
    for p in preds:
        out = out.join(p, on=list(id_cols), how="left")
    return term_columns(out, rs, exits, k0, id_cols)


def term_columns(scored: DataFrame, rs: RuleSet, exits: dict, k0: int = 1, id_cols=ID) -> DataFrame:
    """F1 without joins: the term table of one frame that holds the predictions of all labels."""
    _, pmap = term_names(rs, exits, k0)
    out = scored
    ren = {term_column(a): F.col(f"pred_{a}") for a in rs.activities if f"pred_{a}" in out.columns}
    ren.update({term_column(name): F.col(f"p_{g}_{c}") for (g, c), name in pmap.items() if f"p_{g}_{c}" in out.columns})
    return out.select(*id_cols, *[v.alias(k) for k, v in ren.items()])


def phantom_branches(terms: DataFrame, k0: int) -> DataFrame:
    """dead / phantom branches ``p1 .. p{k0-1}`` are always taken (probability 1)."""
    return terms.withColumns({term_column(f"p{k}"): F.lit(1.0) for k in range(1, k0)})


def evaluate_formulas(terms: DataFrame, formulas: DataFrame, id_cols=ID, name: str = "predicted") -> DataFrame:
    """evaluate each prefix's formula on its terms.

    Few distinct formulas (one per model state) are compiled once to Spark expressions and
    dispatched with one CASE; their number is checked first.  More are evaluated as data, with the same results."""
    distinct = bounded_collect(formulas.select("formula").distinct(), MAX_FORMULAS)
    if distinct is None:
        return evaluate_formula_table(terms, formulas, id_cols, name)
    texts = [r[0] for r in distinct if r[0] is not None]
    known = [c[2:] for c in terms.columns if c.startswith("t_")]
    expr = None
    for t in sorted(texts):
        c = compile_formula(t, known)
        expr = F.when(F.col("formula") == t, c) if expr is None else expr.when(F.col("formula") == t, c)
    joined = terms.join(formulas.select(*id_cols, "formula"), on=list(id_cols), how="inner")
    return joined.withColumn(name, expr if expr is not None else F.lit(None).cast("double"))


def postfix_table(formulas: DataFrame, known) -> DataFrame:
    """(formula, tokens) of the distinct formulas; a formula with other terms than ``known`` is an error."""
    known = set(known)

    def parsed(parts):
        for part in parts:
            rows = []
            for text in part["formula"]:
                node = parse(text)
                if missing := identifiers(node) - known:
                    raise FormulaError(f"unknown terms {sorted(missing)} in {text!r}")
                rows.append([{"op": op, "value": value, "name": term} for op, value, term in postfix(node)])
            yield part.assign(tokens=rows)

    return formulas.select("formula").where("formula is not null").distinct().mapInPandas(parsed, f"formula string, tokens {POSTFIX}")


def evaluate_formula_table(terms: DataFrame, formulas: DataFrame, id_cols=ID, name: str = "predicted") -> DataFrame:
    """F3 for any number of distinct formulas: each is parsed once, into postfix tokens, which every row evaluates on its terms.

    Rows of few formulas meet their tokens in a join on the text, which AQE splits where a formula is frequent."""
    known = [c[2:] for c in terms.columns if c.startswith("t_")]
    values = F.map_from_arrays(F.array(*[F.lit(k) for k in known]), F.array(*[F.col(term_column(k)).cast("double") for k in known])) if known else F.expr("cast(map() as map<string,double>)")
    joined = terms.join(formulas.select(*id_cols, "formula"), on=list(id_cols), how="inner").withColumn("_terms", values)
    tokens = postfix_table(formulas, known).withColumnRenamed("tokens", "_tokens")
    out = joined.join(tokens, "formula", "left").withColumn(name, evaluate_postfix("_tokens", "_terms"))
    return out.select(*joined.columns[:-1], name)


def attach_actual(pred: DataFrame, actual: DataFrame, method: str, cls: str, id_cols=ID, keep=()) -> DataFrame:
    """clip negative predictions, join the actual remaining time, detail-table schema (and the columns ``keep``)."""
    out = M.clip_negative(pred, "predicted").join(actual.select(*id_cols, F.col("remtime").alias("actual")), list(id_cols))
    return out.select(
        F.col(id_cols[0]).alias("case_id"),
        F.col(id_cols[1]).alias("nr_events"),
        "predicted",
        "actual",
        F.lit(method).alias("method"),
        F.lit(cls).alias("cls"),
        *keep,
    )


@dataclass
class FlowConfig:
    ratio: float = 0.8
    min_len: int = 2
    max_len: int | None = None  # longest prefix; None: all prefixes of the log
    max_events: int | None = None  # events with columns of their own in index encodings; None: the longest prefix
    bucket: str = "zero"  # zero | prefix
    encoding: str = "combined"
    model: str = "mean"  # mean (M13) | rf | gbt | xgb | dt | logit (class only)
    params: dict | None = None
    label_params: dict | None = None  # label -> bucket (None: the others) -> parameters, before ``params``
    min_cases: int = 30
    k0: int = 1
    method_name: str = "FA"
    calibrate: float | None = None  # share of a gateway's training cases that its model is fitted on; the later ones calibrate it
    hot_case_rows: int | None = 5_000_000  # cases above this size are encoded in segments


def params_of(cfg: FlowConfig, label: str):
    """The parameters of a label's model as a function of the bucket."""
    own = (cfg.label_params or {}).get(label, {})
    return lambda bucket: own.get(bucket, own.get(None, cfg.params))


# Most buckets whose per-bucket values are applied as literal lookups.
MAX_BUCKETS = 10_000


def bucket_lookup(table: DataFrame, key: str, cols, fallback: dict | None = None) -> dict:
    """Columns that look up per-bucket values of ``table`` (one row per bucket, at most
    ``MAX_BUCKETS``: collected and applied as literal maps, no join); unknown buckets get
    ``fallback``."""
    rows = bounded_collect(table, MAX_BUCKETS)
    if rows is None:
        raise ValueError(f"more than {MAX_BUCKETS} buckets")
    out = {}
    for c in cols:
        pairs = [x for r in rows if r[c] is not None for x in (F.lit(r[key]), F.lit(float(r[c])))]
        look = F.element_at(F.create_map(*pairs), F.col(key)) if pairs else F.lit(None).cast("double")
        fb = (fallback or {}).get(c)
        out[c] = F.coalesce(look, F.lit(fb).cast("double")) if fb is not None else look.cast("double")
    return out


def _hot(log: DataFrame, spec: LogSpec, cfg: "FlowConfig"):
    """Cases of ``log`` too large for one window task (None if there are none)."""
    if cfg.hot_case_rows is None:
        return None
    from procmon.operators.segmented import hot_cases

    return hot_cases(log, spec, cfg.hot_case_rows)


def _bucketed(p: DataFrame, how: str) -> DataFrame:
    return E.bucket_zero(p) if how == "zero" else E.bucket_prefix(p)


# Index encodings hold a set of columns per event position; beyond this a plan can't hold them.
MAX_INDEX_EVENTS = 200


def index_events(train: DataFrame, spec: LogSpec, cfg: FlowConfig) -> int:
    """How many event positions an index encoding has: the longest prefix of the training log, unless ``cfg`` names it."""
    known = cfg.max_events or cfg.max_len
    if known is None:
        longest = train.groupBy(col(spec.case)).count().agg(F.max("count")).first()[0] or 1
        known = max(1, longest - 1)
        if known > MAX_INDEX_EVENTS:
            raise ValueError(f"an index encoding of {known} events: name max_events")
    return known


def prepare(log: DataFrame, spec: LogSpec, cfg: FlowConfig):
    """Split, encode and bucket the prefixes of a log: ``(log, train_prefixes, test_prefixes)``."""
    return prepare_with_hot(log, spec, cfg)[:3]


def prepare_with_hot(log: DataFrame, spec: LogSpec, cfg: FlowConfig):
    """Split, encode (one window pass per split) and bucket the prefixes of a log.
    The log with its remaining times is persisted: the split, the targets and both
    encodings read it."""
    hot = _hot(log, spec, cfg)
    log = T.remaining_time(log, spec, hot=hot).persist()
    train, test = D.temporal_split(log, spec, cfg.ratio, hot=hot)
    keep = ("remtime", spec.activity)
    if cfg.model == "mean":
        vocab, method = E.Vocab({}), "none"
    else:
        vocab, method = E.fit_vocab(train, spec.cat_cols), cfg.encoding
    events = index_events(train, spec, cfg) if "index" in E.METHODS[method] else 0
    train_p, test_p = (
        _bucketed(E.encode(part, spec, vocab, method, cfg.min_len, cfg.max_len, max_events=events, keep=keep, hot=hot), cfg.bucket) for part in (train, test)
    )
    return log, train_p, test_p, hot


def predict_labels(train_p: DataFrame, test_p: DataFrame, targets: DataFrame, rs: RuleSet, exits: dict, cfg: FlowConfig, spec: LogSpec):
    """Predictions for the test prefixes (``pred_<activity>``, ``p_<gateway>_<c>``): a list of one frame with those of all labels."""
    labels = [*rs.activities, *rs.gateways]
    labels += [CASE_START] if cfg.calibrate is not None else []
    tr = train_p.join(targets.select(spec.case, *labels), on=spec.case, how="inner")
    if cfg.model == "mean":
        mt = M.mean_predictor(tr, rs.activities, {g: exits[g] for g in rs.gateways}, by="bucket")
        cols = [f"pred_{a}" for a in rs.activities] + [f"p_{g}_{c}" for g in rs.gateways for c in M.class_list(exits[g])]
        mt = mt.select("bucket", *[F.col(a).alias(f"pred_{a}") for a in rs.activities], *cols[len(rs.activities):])
        # buckets unseen in training: mean / class ratio over the defined targets (Q8)
        fb = M.mean_predictor(targets.withColumn("bucket", F.lit(1)), rs.activities, {g: exits[g] for g in rs.gateways}).first()
        fill = {f"pred_{a}": fb[a] for a in rs.activities}
        fill.update({f"p_{g}_{c}": fb[f"p_{g}_{c}"] for g in rs.gateways for c in M.class_list(exits[g])})
        pred = test_p.select(*ID, "bucket").withColumns(bucket_lookup(mt, "bucket", cols, fill))
        for a in rs.activities:
            pred = M.clip_negative(pred, f"pred_{a}")
        return [pred.drop("bucket")]
    feats = E.feature_names(train_p)
    if cfg.calibrate is not None:
        return [_calibrated(tr, test_p, targets, rs, exits, cfg, spec, feats)]
    return [EN.score(test_p, fit_labels(checkpointed(M.assembled(tr, feats)), rs, exits, cfg, feats))]


def _calibrated(tr: DataFrame, test_p: DataFrame, targets: DataFrame, rs: RuleSet, exits: dict, cfg: FlowConfig, spec: LogSpec, feats) -> DataFrame:
    """F5 with M10: of the training cases on which a gateway is defined, the first ``cfg.calibrate`` (by start) fit its
    model and the prefixes of the others its calibration, per bucket and exit; cycle times use all training cases.

    The validation prefixes of all gateways are scored in one pass, and so are the test prefixes."""
    tr = checkpointed(tr.withColumn("_row", F.monotonically_increasing_id()))
    starts = tr.select(col(spec.case).alias(spec.case), CASE_START, *rs.gateways).dropDuplicates([spec.case]).persist()
    fits = {g: D.first_part(starts.where(F.col(g).isNotNull()), [CASE_START, spec.case], cfg.calibrate) for g in rs.gateways}
    starts.unpersist()
    models = [M.fit_buckets(tr, a, "regr", feats, cfg.model, params_of(cfg, a), cfg.min_cases) for a in rs.activities]
    gateways = [M.fit_buckets(tr.where(fits[g]), g, "class", feats, cfg.model, params_of(cfg, g), cfg.min_cases, exits[g]) for g in rs.gateways]
    columns = {f"p_{g}_{c}": (g, c) for g in rs.gateways for c in M.class_list(exits[g])}
    if not columns:
        return EN.score(test_p, models)
    scored = EN.score(tr, gateways, ("_row",), keep=("bucket", spec.case, CASE_START, *rs.gateways))
    point = [
        F.when(F.col(g).isNotNull() & ~fits[g], F.struct(F.lit(g).alias("label"), F.lit(int(c)).alias("class"), F.col(n).alias("x"), (F.col(g) == c).cast("int").alias("y")))
        for n, (g, c) in columns.items()
    ]
    points = scored.select("bucket", F.explode(F.array(*point)).alias("p")).where("p is not null").select("bucket", "p.*")
    calibration = K.fit(points, ("label", "bucket", "class"))
    out = K.apply(EN.score(test_p, models + gateways, keep=("bucket",)), calibration, columns)
    return K.normalise(out, [[n for n, (h, _) in columns.items() if h == g] for g in rs.gateways]).drop("bucket")


def checkpointed(rows: DataFrame) -> DataFrame:
    """Rows that the model of every label and bucket reads, in the shared folder."""
    checkpoint_dir(rows.sparkSession)
    return rows.checkpoint(eager=True)


def fit_labels(rows: DataFrame, rs: RuleSet, exits: dict, cfg: FlowConfig, feats) -> list:
    """M7: the models of every cycle time and gateway on one table of encoded training prefixes with all labels.

    With one bucket, some labels are fitted at a time; otherwise the buckets of a label are."""

    def fit(label):
        mode = "regr" if label in rs.activities else "class"
        return M.fit_buckets(rows, label, mode, feats, cfg.model, params_of(cfg, label), cfg.min_cases, exits.get(label, 0))

    labels = [*rs.activities, *rs.gateways]
    values = M.values_of(rows.count(), len(feats), cfg.params if cfg.model == "rf" else {}) if cfg.bucket == "zero" else M.MAX_VALUES
    return M.at_once([lambda a=a: fit(a) for a in labels], values)


def gateway_classes(targets: DataFrame, gateways) -> dict:
    """The defined classes of each gateway in ascending order (one row per gateway)."""
    gateways = list(gateways)
    if not gateways:
        return {}
    row = targets.agg(*[F.sort_array(F.collect_set(F.col(g).cast("int"))).alias(g) for g in gateways]).first()
    return {g: list(row[g] or []) for g in gateways}


def predict_flow(log: DataFrame, spec: LogSpec, rs: RuleSet, formulas_of, cfg: FlowConfig) -> DataFrame:
    """flow-analysis prediction of the remaining time; returns the detail table.

    ``formulas_of(test_prefixes)`` gives ``(case_id, prefix_len, formula)``."""
    log, train_p, test_p, hot = prepare_with_hot(log, spec, cfg)
    targets = L.build_targets(log, spec, rs, hot=hot)
    if cfg.calibrate is not None:
        targets = targets.join(D.case_starts(log, spec).withColumnRenamed("_start", CASE_START), spec.case)
    exits = gateway_classes(targets, rs.gateways)
    preds = predict_labels(train_p, test_p, targets, rs, exits, cfg, spec)
    terms = phantom_branches(term_columns(preds[0], rs, exits, cfg.k0), cfg.k0)
    pred = evaluate_formulas(terms, formulas_of(test_p))
    return attach_actual(pred, test_p, cfg.method_name, cfg.model)


def predict_direct(log: DataFrame, spec: LogSpec, cfg: FlowConfig) -> DataFrame:
    """one regressor (per bucket) on the remaining time of the prefix; detail table.
    ``model='mean'`` predicts the bucket's mean remaining time (event mean, Q9)."""
    log, train_p, test_p = prepare(log, spec, cfg)
    if cfg.model == "mean":
        mt = train_p.groupBy("bucket").agg(F.avg("remtime").alias("predicted"))
        overall = train_p.agg(F.avg("remtime")).first()[0]
        pred = test_p.withColumns(bucket_lookup(mt, "bucket", ["predicted"], {"predicted": overall}))
    else:
        feats = E.feature_names(train_p)
        lm = M.fit_buckets(train_p, "remtime", "regr", feats, cfg.model, params_of(cfg, "remtime"), cfg.min_cases)
        pred = EN.score(test_p, [lm]).withColumnRenamed("pred_remtime", "predicted")
    return attach_actual(pred.select(*ID, "predicted"), test_p, "direct", cfg.model)
