"""Information-theoretic sanitisation of personal data, on DataFrame functions alone.

Base entities (e-mail and IP addresses, card and phone numbers) are found by fixed
patterns and checks.  They are the protected entities.  Around each occurrence,
the words within ``CONTEXT`` code points are terms that may give the entity away.
Corpus counts estimate how strongly: with N documents, n(e) of which hold the entity
e, and P(e | t) the chance that a document with term t holds e near it, the term
discloses PMI(e; t) = log2(P(e | t) * N / n(e)) of the entity's log2(N / n(e)) bits.
A term that discloses at least ``REMOVE`` of them is removed, one that discloses at
least ``GENERALISE`` is replaced by its class (number, code, name or word), in the documents that hold the
entity.  Terms are runs of at least three letters and digits, so account and order numbers count.  P(e | t) is Wilson's lower bound (``Z``) of the share of documents with t that
have e near it, where all documents with the same context count as one.  So no
entity is too rare to be protected, few observations disclose less than many, and
copies of one passage prove no more than one.

Counts cover all documents.  Documents without a base entity hold nothing that is
protected and stay as they are.

Spans are ``kind:start:end`` in code points, the end exclusive: base kinds first,
as listed in KINDS, then ``generalise`` and ``remove``, each by start.  A term inside
a base span is part of that span.  Null and empty texts have no spans and stay
null or empty.  Repeated rows give repeated results; null ids are allowed; an empty
table gives no rows.  Extra columns are kept by ``sanitise`` and ignored by
``report``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procmon.llm.common import written

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns, written so that each match begins where the plain pattern's would and no start is tried twice.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
CONTEXT = 48
Z = 1.2816  # of a one-sided bound that holds with a chance of 0.9
GENERALISE, REMOVE = 0.75, 0.9
TERM = r"[\p{L}\p{N}]{3,}"
# Classes that a generalised term is replaced by, the first whose shape fits.
CLASSES = {"NUMBER": r"^\\p{N}+$", "CODE": r"\\p{N}", "NAME": r"^\\p{Lu}", "WORD": ""}
SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"
_T, _SPANS, _ROW = "__text", "__spans", "__row"


def _spans(text: str, pattern: str, kind: str) -> str:
    """SQL: the matches of a pattern as (kind, start, end, value), left to right.

    The parts between the matches and the matches themselves alternate, so
    their lengths add up to the positions.
    """
    step = "(s, p) -> named_struct('at', s.at + length(p.part) + length(p.hit), 'out', concat(s.out, array(named_struct('kind', {k}, 'start', s.at + length(p.part), 'end', s.at + length(p.part) + length(p.hit), 'value', p.hit))))".format(k=kind)
    pairs = f"zip_with(slice(parts, 1, size(hits)), hits, (a, b) -> named_struct('part', a, 'hit', b))"
    body = f"aggregate({pairs}, named_struct('at', 0, 'out', cast(array() as {SPAN})), {step}).out"
    return f"transform(array(named_struct('parts', split({text}, {pattern}, -1), 'hits', regexp_extract_all({text}, {pattern}, 0))), z -> {body.replace('parts', 'z.parts').replace('hits', 'z.hits')})[0]"


def _literal(pattern: str) -> str:
    return "r'" + pattern + "'"


def _valid(kind: str) -> str:
    """SQL: whether the match ``m.value`` passes the checks of its kind."""
    digits = "regexp_replace(m.value, '[^0-9]', '')"
    if kind == "ip":
        return "forall(split(m.value, r'\\.'), p -> length(ltrim('0', p)) <= 3 and int(concat('0', right(ltrim('0', p), 3))) <= 255)"
    if kind == "card":
        double = "case when (length(d) - i) % 2 = 0 then int(substring(d, i, 1)) when int(substring(d, i, 1)) > 4 then 2 * int(substring(d, i, 1)) - 9 else 2 * int(substring(d, i, 1)) end"
        luhn = f"aggregate(sequence(1, length(d)), 0, (acc, i) -> acc + {double}) % 10 = 0"
        return f"transform(array({digits}), d -> if(length(d) between 13 and 19, {luhn}, false))[0]"
    if kind == "phone":
        return f"length({digits}) between 9 and 15"
    return "true"


def base_spans(text: str) -> Column:
    """All base entities of a text column: (kind, start, end, value), by kind and start."""
    found = []
    for i, kind in enumerate(KINDS):
        matches = _spans(text, _literal(PATTERNS[kind]), str(i))
        found.append(f"if({text} rlike {_literal(HINTS[kind])}, filter({matches}, m -> {_valid(kind)}), cast(array() as {SPAN}))")
    return F.expr(f"concat({', '.join(found)})")


def _marked(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.withColumn(_T, F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).withColumn(_SPANS, base_spans(_T))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def lower_bound(hits: Column, trials: Column) -> Column:
    """Wilson's lower bound of a share."""
    p, n, z2 = hits / trials, trials, Z * Z
    return (p + z2 / (2 * n) - Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def disclosing(dirty: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, term, remove): the terms to mask in each document that holds a base entity.

    ``dirty`` holds the documents with base entities (row, text, spans); ``docs``
    is the whole corpus, for the document frequencies.
    """
    total = docs.count()
    entity = F.expr("case when e.kind >= 2 then regexp_replace(e.value, '[^0-9]', '') else lower(e.value) end")
    seen = dirty.select(F.col(_ROW).alias("row"), _T, F.explode(_SPANS).alias("e")).select("row", "e.kind", entity.alias("value"), F.expr(f"concat(substring({_T}, greatest(1, e.start - {CONTEXT} + 1), least(e.start, {CONTEXT})), ' ', substring({_T}, e.end + 1, {CONTEXT}))").alias("context"))
    holders = seen.groupBy("kind", "value").agg(F.countDistinct("row").alias("n_e"))
    near = seen.select("row", "kind", "value", F.xxhash64("context").alias("context"), F.explode(_terms(F.col("context"))).alias("term"))
    pairs = near.groupBy("kind", "value", "term").agg(F.countDistinct("row").alias("n_et"), F.countDistinct("context").alias("contexts"))
    pairs = written(pairs.join(holders, ["kind", "value"]), "pairs")
    words = docs.select(F.explode(_terms(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).alias("term"))
    df = words.groupBy("term").agg(F.count("*").alias("df"))
    told = pairs.join(df, "term")
    bits = F.log2(F.lit(float(max(total, 2))) / F.col("n_e"))
    seen_once = F.least("contexts", "n_et")
    share = (bits + F.log2(lower_bound(seen_once, seen_once + F.greatest(F.col("df") - F.col("n_et"), F.lit(0))))) / F.greatest(bits, F.lit(1e-9))
    told = told.select("kind", "value", "term", share.alias("share")).where(F.col("share") >= GENERALISE)
    told = written(told, "told")
    # a document's own terms and entities, of those that disclose or are disclosed at all, meet inside the document
    own = dirty.select(F.col(_ROW).alias("row"), F.explode(_terms(F.col(_T))).alias("term")).join(told.select("term").distinct(), "term", "left_semi")
    held = seen.select("row", "kind", "value").distinct().join(told.select("kind", "value").distinct(), ["kind", "value"], "left_semi")
    met = own.join(held, "row").join(told, ["kind", "value", "term"])
    return met.groupBy("row", "term").agg((F.max("share") >= REMOVE).alias("remove"))


def _term_spans(terms: str, kind: int) -> str:
    """SQL: the spans of a list of terms in the text, outside base spans."""
    pattern = f"concat(r'(?iu)(?<![\\p{{L}}\\p{{N}}])(?:', array_join(array_sort({terms}), '|'), r')(?![\\p{{L}}\\p{{N}}])')"
    found = _spans(_T, "pat", str(kind)).replace("pat", "y")
    outside = f"filter(transform(array({pattern}), y -> {found})[0], m -> not exists({_SPANS}, b -> b.start < m.end and m.start < b.end))"
    return f"if(size({terms}) = 0, cast(array() as {SPAN}), {outside})"


def find(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(clean, dirty): the documents without and with base entities; dirty ones have all spans in ``__spans`` and their base spans in ``__base``.

    Documents with entities are written once, numbered; the others are read again.
    """
    marked = _marked(docs, text_col)
    dirty = written(marked.where(F.size(_SPANS) > 0).withColumn(_ROW, F.monotonically_increasing_id()), "dirty")
    clean = marked.where(F.size(_SPANS) == 0).drop(_T, _SPANS)
    terms = disclosing(dirty, docs, text_col).groupBy(F.col("row").alias(_ROW)).agg(F.collect_list(F.when(~F.col("remove"), F.col("term"))).alias("__general"), F.collect_list(F.when(F.col("remove"), F.col("term"))).alias("__removed"))
    joined = dirty.join(terms, _ROW, "left")
    for name in ("__general", "__removed"):
        joined = joined.withColumn(name, F.coalesce(F.col(name), F.expr("cast(array() as array<string>)")))
    joined = joined.withColumn("__base", F.col(_SPANS))
    return clean, joined.withColumn(_SPANS, F.expr(f"concat({_SPANS}, {_term_spans('__general', len(KINDS))}, {_term_spans('__removed', len(KINDS) + 1)})"))


def _span_text(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in (*KINDS, "generalise", "remove"))
    return f"array_join(transform({spans}, s -> concat(array({names})[s.kind], ':', s.start, ':', s.end)), ',')"


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    clean, dirty = find(docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")), "t")
    none = clean.select(F.col("k").alias(id_col), *(F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(F.lit("").cast("binary"), 256).alias("base_sha256"), F.lit("").alias("spans"))
    some = dirty.select(
        F.col("k").alias(id_col),
        *(F.expr(f"cast(size(filter(__base, s -> s.kind = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(F.expr(_span_text("__base")).cast("binary"), 256).alias("base_sha256"),
        F.expr(_span_text(_SPANS)).alias("spans"),
    )
    return none.unionByName(some)


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with base entities replaced by their kinds, generalised terms by their classes (``CLASSES``) and removed terms taken out; all columns stay."""
    clean, dirty = find(docs, text_col)
    marks = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    general = " ".join(f"when m.value rlike '{shape}' then '[{name}]'" for name, shape in CLASSES.items())
    mark = f"case when m.kind < {len(KINDS)} then array({marks})[m.kind] when m.kind > {len(KINDS)} then '' {general} end"
    ordered = f"array_sort({_SPANS}, (a, b) -> case when a.start != b.start then a.start - b.start else b.end - a.end end)"
    step = f"(s, m) -> if(m.start < s.at, named_struct('at', greatest(s.at, m.end), 'out', s.out), named_struct('at', m.end, 'out', concat(s.out, substring({_T}, s.at + 1, m.start - s.at), {mark})))"
    built = f"transform(array(aggregate({ordered}, named_struct('at', 0, 'out', ''), {step})), e -> concat(e.out, substring({_T}, e.at + 1)))[0]"
    fixed = dirty.withColumn(text_col, F.expr(built)).select(*(F.col(f"`{c}`") for c in docs.columns))
    return clean.unionByName(fixed)
