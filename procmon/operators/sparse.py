"""Sparse encodings (E1-E8, E10): a feature store of spans, a vocabulary table, vectors for MLlib.

The dense encoders hold a literal column for each level and event position.  Here a categorical level or an event position
is a row instead.  A *span* ``(case, feature, value, _from, _to)`` says that the feature has the value in the
prefixes of ``_from .. _to`` events of the case, and 0 (or no value) elsewhere:

* static: from the first event that has a value to the end of the case;
* last: from an event that has a value to the one before the next such event;
* agg: a level's count, until the level occurs again; numbers have a span a prefix;
* bool: from the level's first occurrence on;
* index: event ``i`` from itself on; previous: an event in the one prefix it is second to last in.

So the store has at most a few rows for each event and column, whatever the number of levels, positions and prefixes.
``fit_features`` numbers the features of the training spans; others are unseen and get no entry.  Neither table passes the driver.
Prefixes are resolved at the sink: by ``expand`` (long form) or ``vectors`` (a sparse vector a prefix).

Features are named ``part__column`` (numbers) and ``part__column=level``, positions ``index__column[i]``; in column names ``%``,
``=`` and ``[`` are written as ``%25``, ``%3D`` and ``%5B``, so that no two features share a name.  Nulls have no span, empty texts
are levels, events without a case id form one case, and logs without prefixes give empty tables.
"""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procmon.operators import encode as E
from procmon.operators import segmented as G
from procmon.session import scratch_path
from procmon.spec import LogSpec, col

# positions of a hot case in one window partition of a feature
BLOCK = 1_000_000
# prefixes whose vectors are made from one list of spans
PREFIX_BLOCK = 64
# a vocabulary up to this many features (counted first) is broadcast, a larger one is shuffled
BROADCAST_FEATURES = 200_000
# buckets in which features are numbered: the table of their sizes has a row a bucket
NUMBER_BUCKETS = 256
VECTOR = "sparse__features"


def _escaped(name: str) -> str:
    return name.replace("%", "%25").replace("=", "%3D").replace("[", "%5B")


def _positions(df: DataFrame, spec: LogSpec, hot: DataFrame | None) -> DataFrame:
    if hot is not None:
        return G.case_context(df, spec, hot)
    return df.withColumns({"_pos": F.row_number().over(spec.window()), "_len": F.count(F.lit(1)).over(spec.whole_case())})


def _hits(events: DataFrame, spec: LogSpec, cat, num) -> DataFrame:
    """``(case, _pos, _len, name, level, value)``: a row for each value that is not null."""
    entry = lambda c, level, value: F.struct(F.lit(_escaped(c)).alias("name"), level.alias("level"), value.alias("value"))
    one, none = F.lit(1.0), F.lit(None).cast("string")
    entries = [F.when(col(c).isNotNull(), entry(c, col(c).cast("string"), one)) for c in cat]
    entries += [F.when(col(c).isNotNull(), entry(c, none, col(c).cast("double"))) for c in num]
    entries = F.array(*entries) if entries else F.array().cast("array<struct<name:string,level:string,value:double>>")
    x = events.select(col(spec.case).alias("_case"), F.col("_pos").cast("int").alias("_pos"), F.col("_len").cast("int").alias("_len"), F.explode(entries).alias("_h"))
    return x.where("_h IS NOT NULL").select("_case", "_pos", "_len", "_h.*")


def _repeats(hits: DataFrame, keys: list[str], hot: DataFrame | None, block: int) -> DataFrame:
    """``_nth`` (running count) and ``_next`` (position of the next hit) among the hits that share ``keys``.

    With hot cases a key's hits are windowed in blocks of positions; what the other blocks add comes from a row a block."""
    if hot is None:
        w = Window.partitionBy(*keys).orderBy("_pos")
        return hits.withColumns({"_nth": F.row_number().over(w), "_next": F.lead("_pos").over(w)})
    x = hits.withColumn("_block", F.floor(F.col("_pos") / block))
    own = [*keys, "_block"]
    parts = x.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_head"))
    w = Window.partitionBy(*keys).orderBy("_block")
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carry = parts.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(own)], before.alias("_before"), F.lead("_head").over(w).alias("_after"))
    same = F.lit(True)
    for i, k in enumerate(own):
        same = same & F.col(k).eqNullSafe(F.col(f"_r{i}"))
    w = Window.partitionBy(*own).orderBy("_pos")
    x = x.withColumns({"_nth": F.row_number().over(w), "_next": F.lead("_pos").over(w)}).join(carry, same, "left")
    x = x.withColumns({"_nth": F.col("_nth") + F.col("_before"), "_next": F.coalesce("_next", "_after")})
    return x.drop("_block", "_before", "_after", *[f"_r{i}" for i in range(len(own))])


def _feature(part: str, position: Column | None = None) -> Column:
    """The name of a hit's feature."""
    at = [] if position is None else [F.lit("["), position.cast("string"), F.lit("]")]
    level = F.when(F.col("level").isNotNull(), F.concat(F.lit("="), F.col("level"))).otherwise("")
    return F.concat(F.lit(f"{part}__"), F.col("name"), *at, level)


def _numbers(df: DataFrame, spec: LogSpec, tag: str, strict: bool, hot: DataFrame | None) -> DataFrame:
    """Running mean, max, min, sum and deviation: one span a prefix, from the dense encoder (its columns do not grow with the data)."""
    plain = spec.with_(static_cat=(), dynamic_cat=())
    x = E.encode(df, plain, E.Vocab({}), tag, strict=strict, hot=hot)
    names = E.feature_names(x)
    pairs = F.array(*[F.struct(F.lit(f"{tag}__{stat}_{_escaped(c)}").alias("feature"), col(f"{tag}__{stat}_{c}").alias("value"))
                      for c in spec.dynamic_num for stat in ("mean", "max", "min", "sum", "std") if f"{tag}__{stat}_{c}" in names])
    x = x.select(col(spec.case).alias("_case"), F.col("prefix_len").cast("int").alias("_from"), F.explode(pairs).alias("_p"))
    return x.select("_case", "_p.feature", "_p.value", "_from", F.col("_from").alias("_to"))


def spans(
    df: DataFrame,
    spec: LogSpec,
    method: str = "combined",
    min_len: int = 1,
    max_len: int | None = None,
    strict: bool = True,
    hot: DataFrame | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """``(case, feature, value, _from, _to)``, values other than 0, clipped to the prefixes asked for.

    ``method`` is one of ``encode.METHODS``; ``strict`` and ``hot`` are those of ``encode.encode``."""
    events = _positions(df, spec, hot)
    end = F.col("_len") - 1 if strict else F.col("_len")
    out = []

    def add(x, feature, first, last):
        out.append(x.select("_case", feature.alias("feature"), "value", first.alias("_from"), last.alias("_to")))

    pos = F.col("_pos")
    dynamic = _hits(events, spec, spec.dynamic_cat, spec.dynamic_num)
    levels = _hits(events, spec, spec.dynamic_cat, ())
    for part in E.METHODS[method]:
        if part == "static":
            x = _hits(events, spec, spec.static_cat, spec.static_num)
            x = x.groupBy("_case", "name").agg(F.min_by(F.struct("level", "value"), "_pos").alias("_h"), F.min("_pos").alias("_pos"), F.max("_len").alias("_len"))
            add(x.select("_case", "name", "_pos", "_len", "_h.*"), _feature(part), pos, end)
        elif part == "last":
            x = _repeats(dynamic, ["_case", "name"], hot, block)
            add(x, _feature(part), pos, F.coalesce(F.col("_next") - 1, end))
        elif part == "agg":
            x = _repeats(levels, ["_case", "name", "level"], hot, block).withColumn("value", F.col("_nth").cast("double"))
            add(x, _feature(part), pos, F.coalesce(F.col("_next") - 1, end))
        elif part == "bool":
            x = levels.groupBy("_case", "name", "level").agg(F.min("_pos").alias("_pos"), F.max("_len").alias("_len"), F.first("value").alias("value"))
            add(x, _feature(part), pos, end)
        elif part == "index":
            add(dynamic, _feature(part, pos - 1), pos, end)
        elif part == "previous":
            add(dynamic.where(pos + 1 <= end), _feature(part), pos + 1, pos + 1)
        if part in ("agg", "bool") and spec.dynamic_num:
            out.append(_numbers(df, spec, part, strict, hot))
    if not out:
        add(levels.where("false"), _feature("none"), pos, pos)
    x = out[0]
    for y in out[1:]:
        x = x.unionByName(y)
    last = F.col("_to") if max_len is None else F.least(F.col("_to"), F.lit(max_len))
    x = x.withColumns({"_from": F.greatest(F.col("_from"), F.lit(min_len)).cast("int"), "_to": last.cast("int")})
    return x.where("_from <= _to AND value <> 0").select(F.col("_case").alias(spec.case), "feature", "value", "_from", "_to")


def below(store: DataFrame, max_events: int) -> DataFrame:
    """The store with the index features of the first ``max_events`` positions only."""
    at = F.regexp_extract("feature", r"^index__[^=\[]*\[(\d+)\]", 1)
    return store.where((at == "") | (at.cast("int") < max_events))


def expand(store: DataFrame, key: str = "prefix_len") -> DataFrame:
    """The long form: a row for each prefix and feature whose value is not 0, without a further shuffle."""
    return store.withColumn(key, F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")


# -- vocabulary ---------------------------------------------------------------------


def fit_features(store: DataFrame) -> DataFrame:
    """E8 (fit): ``(feature, idx)``, the training features numbered from 0 without gaps, as a written table.

    Numbers follow hash buckets and, inside one, names: the same features get the same numbers on every run."""
    spark = store.sparkSession
    path = scratch_path(spark, "features")
    names = store.select("feature").distinct().withColumn("_b", F.pmod(F.xxhash64("feature"), F.lit(NUMBER_BUCKETS)))
    names.write.parquet(path)
    names = spark.read.parquet(path)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over a row a bucket
    sizes = names.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("feature")) - 1
    numbered = names.withColumn("_i", place).join(F.broadcast(sizes), "_b").select("feature", (F.col("_i") + F.col("_off")).cast("int").alias("idx"))
    numbered.write.parquet(f"{path}-numbered")
    return spark.read.parquet(f"{path}-numbered")


def coded(store: DataFrame, vocab: DataFrame) -> DataFrame:
    """E8 (apply): the spans of known features with their ``idx``; unseen features have none.

    A frequent feature's spans are not gathered: the vocabulary is broadcast when it is small, otherwise AQE splits the hot keys."""
    names = F.broadcast(vocab) if vocab.count() <= BROADCAST_FEATURES else vocab
    return store.join(names, "feature")


# -- vectors ----------------------------------------------------------------------


def prefixes(df: DataFrame, spec: LogSpec, min_len: int = 1, max_len: int | None = None, keep=(), key: str = "prefix_len", strict: bool = True, hot=None) -> DataFrame:
    """``(case, prefix_len)`` of every prefix, with the ``keep`` columns of its last event."""
    x = _positions(df, spec, hot).withColumn(key, F.col("_pos").cast("int"))
    cond = (F.col(key) >= min_len) & (F.col(key) < F.col("_len") + (0 if strict else 1))
    if max_len is not None:
        cond = cond & (F.col(key) <= max_len)
    return x.where(cond).select(col(spec.case).alias(spec.case), key, *[col(k).alias(k) for k in keep])


def _vectors(base: DataFrame, store: DataFrame, vocab: DataFrame, spec: LogSpec, key: str) -> DataFrame:
    block = lambda c: F.floor(F.col(c) / PREFIX_BLOCK)
    x = coded(store, vocab).withColumn("_block", F.explode(F.sequence(block("_from"), block("_to"))))
    entry = F.struct("idx", "value", "_from", "_to")
    lists = x.groupBy(col(spec.case).alias("_case"), F.col("_block").alias("_blk")).agg(F.array_sort(F.collect_list(entry)).alias("_spans"))
    same = col(spec.case).eqNullSafe(F.col("_case")) & (F.col("_block") == F.col("_blk"))
    x = base.withColumn("_block", block(key)).join(lists, same, "left").drop("_case", "_block", "_blk")
    x = x.withColumn("_spans", F.filter("_spans", lambda s: (s["_from"] <= F.col(key)) & (s["_to"] >= F.col(key))))
    size = F.lit(vocab.count()).cast("int")
    parts = {"type": F.lit(0).cast("tinyint"), "size": size,
             "indices": F.coalesce(F.col("_spans.idx"), F.array().cast("array<int>")),
             "values": F.coalesce(F.col("_spans.value"), F.array().cast("array<double>"))}
    return x.withColumn(VECTOR, F.struct(*[v.alias(k) for k, v in parts.items()])).drop("_spans")


def vectors(base: DataFrame, store: DataFrame, vocab: DataFrame, spec: LogSpec, key: str = "prefix_len") -> DataFrame:
    """The prefixes of ``base`` with the column ``sparse__features``, an MLlib sparse vector over ``vocab``.

    ``base`` and ``store`` must be of the same log.  Spans are gathered for ``PREFIX_BLOCK`` neighbouring prefixes of a case, so a list holds
    little more than one vector's entries and the changes in the block, and a hot case is spread over its blocks.  A prefix without
    known features has an empty vector.  The rows are written in the form of MLlib's own vectors, in the shared folder, and read back:
    that cuts the lineage before the fits that reread them, and no vector is made in Python."""
    path = scratch_path(base.sparkSession, "vectors")
    x = _vectors(base, store, vocab, spec, key)
    x.write.parquet(path)
    size = {"ml_attr": {"num_attrs": vocab.count()}}  # MLlib's assembler asks for the length
    fields = [T.StructField(f.name, VectorUDT(), metadata=size) if f.name == VECTOR else f for f in x.schema.fields]
    return base.sparkSession.read.schema(T.StructType(fields)).parquet(path)


def entries(base: DataFrame, store: DataFrame, vocab: DataFrame, spec: LogSpec, key: str = "prefix_len") -> DataFrame:
    """The entries of the vectors in long form, with the features' names: ``(case, prefix_len, feature, value)``."""
    x = _vectors(base, store, vocab, spec, key)
    x = x.select(col(spec.case), key, F.explode(F.arrays_zip(F.col(f"{VECTOR}.indices").alias("idx"), F.col(f"{VECTOR}.values").alias("value"))).alias("_e"))
    return x.select(col(spec.case), key, "_e.idx", "_e.value").join(vocab, "idx").drop("idx")
