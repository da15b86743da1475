"""Document fingerprints by invertible Bloom lookup tables, on DataFrame functions alone.

A text is cut where its content says so: it is read as tokens (up to 12 code points of a
word with the white space or marks after it), and a token ends a paragraph if its hash
modulo ``PIECE`` is less than its length.  So paragraphs have about ``PIECE`` code points in any script,
and a cut depends on the token before it only.  (U+0001 ends one, too; a text of one token again and again may have no other end.)  A paragraph is known by a
digest of 64 bits, the last 20 of which are its length in code points (``LENGTH`` at most).

A text's distinct digests are dealt by hash into blocks, a power of two of them, so that a block holds
``BLOCK`` or fewer on average.  A block is a table of 24 cells, and each digest is
added to one cell in each third of it; a cell holds the number of its digests, their
exclusive or, and the exclusive or of check values of theirs.  The cells that are not empty, as text, are the
fingerprint: two fingerprints can be compared without the texts.

Two tables are compared by subtracting cells, those of the larger one folded to the blocks of the smaller.
What both hold cancels out; a cell with a single digest left (its check value tells) gives the digest away,
which is then taken out of its other cells, and so on until all cells are empty.  All pairs are peeled at once:
a round looks at one third of the cells, where a digest has one place, and is an aggregation of what
is left by pair and cell.  If cells remain, the difference is too large for the tables, and it is retried with a
larger one: blocks for the digests of both texts, of 60 cells, with other hash functions.  (If even that fails,
the digests are compared as sets.)

With digests of a and b code points and recovered ones of d, the likeness is
(a + b - d) / (a + b + d), the share of common paragraphs in all, by length (1 if neither text has any).

Exchanges carry each text once, to its neighbours, and its digests to the first tables, to the fingerprints and, where a
pair failed, to the larger tables; cells are aggregated where their rows lie.  Null texts count as empty and have no paragraphs.  Rows that repeat an id are
ordered by their text, null ids come first.  The only document of a table is its
own successor.  An empty table gives no rows.  Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procmon.llm.common import drop_written, partitions, written

GAP = r"\s\x{3001}\x{3002}\x{FF01}\x{FF0C}\x{FF1A}\x{FF1B}\x{FF1F}"  # white space and the marks of scripts that have none
TOKEN = rf"[^{GAP}]{{1,12}}+[{GAP}]{{0,12}}+|[{GAP}]{{1,12}}+"
PIECE = 128  # code points of a paragraph, on average
END = "\\u0001"
LENGTH = 0xFFFFF  # the bits of a digest that hold its length
CELLS, RETRY_CELLS = 24, 60
BLOCK = 16  # digests of a text that a block holds at most, on average
RETRY_BLOCK = 24  # digests of both texts that a block of a retry holds on average
ROUNDS, RETRY_ROUNDS = 9, 15  # each looks at one third of the cells
FOUND = -1  # the cell that adds up the lengths of recovered digests
KNOTS, MAX_BUCKETS = 64, 1 << 16
BUCKET_ROWS = 100


# -- paragraphs ------------------------------------------------------------------


def digests(text: str) -> str:
    """SQL: the digests of a text's paragraphs, one after the other."""
    ends = f"pmod(xxhash64(t), {PIECE}) < length(t)"
    marked = f"array_join(transform(regexp_extract_all({text}, r'{TOKEN}', 0), t -> if({ends}, concat(t, '{END}'), t)), '')"
    digest = f"(xxhash64(p) & {~LENGTH}L) | least(length(p), {LENGTH})"
    return f"transform(filter(split({marked}, '{END}'), p -> p != ''), p -> {digest})"


def kept_digests(keys: str, length: str) -> str:
    """SQL: (n, at): the first ``n`` digests of a text, which end before its first ``length`` code points do, at ``at``.

    A paragraph that ends earlier than that is one of any text that begins with those code points.
    """
    own = f"(k & {LENGTH}L)"
    step = f"(s, k) -> if(s.open and {own} < {LENGTH} and s.at + {own} < {length}, named_struct('n', s.n + 1, 'at', s.at + {own}, 'open', true), named_struct('n', s.n, 'at', s.at, 'open', false))"
    return f"aggregate({keys}, named_struct('n', 0, 'at', 0L, 'open', true), {step})"


def total(keys: str) -> str:
    return f"aggregate({keys}, 0L, (acc, k) -> acc + (k & {LENGTH}L))"


def _buckets(rows: DataFrame) -> tuple[Column, list]:
    """A bucket number that grows with ``k`` (null ids: -1), from quantiles of the ids and even steps between them."""
    n, low, high = rows.agg(F.count("k"), F.min("k"), F.max("k")).first()
    if not n:
        return F.lit(-1), []
    knots = sorted({*rows.agg(F.percentile_approx("k", [i / KNOTS for i in range(1, KNOTS)], 10_000)).first()[0], low, high})
    steps = max(1, min(MAX_BUCKETS, -(-n // BUCKET_ROWS)) // max(1, len(knots) - 1))

    def pick(a: int, b: int) -> Column:
        """The bucket of ids from knot ``a`` up to knot ``b``, by halving."""
        if b - a <= 1:
            if len(knots) == 1:
                return F.lit(0)
            width = max(1, -(-(knots[a + 1] - knots[a]) // steps))
            return F.lit(a * steps) + F.least(F.floor((F.col("k") - F.lit(knots[a])) / F.lit(width)), F.lit(steps - 1)).cast("int")
        mid = (a + b) // 2
        return F.when(F.col("k") < F.lit(knots[mid]), pick(a, mid)).otherwise(pick(mid, b))

    return F.when(F.col("k").isNull(), F.lit(-1)).otherwise(pick(0, max(1, len(knots) - 1))), knots


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, t, a, next): each text with its digests and those of the next document (after the last: the first).

    Documents are dealt into buckets of neighbouring ids in one exchange; the
    first row of each bucket also goes, marked, to the end of the bucket before.
    The table of first rows has one row a bucket, at most MAX_BUCKETS and KNOTS.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    bucket, _ = _buckets(rows.select("k"))
    firsts = rows.select(bucket.alias("bucket"), "k").groupBy("bucket").agg(F.min("k").alias("first"))
    around = Window.orderBy("bucket")
    firsts = firsts.select("first", F.coalesce(F.lag("bucket").over(around), F.max("bucket").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    marked = rows.withColumn("own", bucket).join(F.broadcast(firsts), F.col("k").eqNullSafe(F.col("first")), "left")
    places = F.when(F.col("before").isNull(), F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("mark")))).otherwise(
        F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("mark")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("mark")))
    )
    dealt = marked.select("k", "t", F.explode(places).alias("p")).select("k", "t", "p.bucket", "p.mark").repartition("bucket")
    dealt = dealt.withColumn("a", F.expr(digests("t")))
    order = Window.partitionBy("bucket").orderBy("mark", F.col("k").asc_nulls_first(), "t")
    return dealt.withColumn("next", F.lead(F.struct("t", "a")).over(order)).where("not mark")


# -- tables -----------------------------------------------------------------------


def _cell(key: str, blocks: str, cells: int, third: int) -> str:
    """SQL: a digest's cell in a third of its block; the table's size is the seed."""
    of = cells // 3
    return f"pmod(shiftrightunsigned({key}, 24), {blocks}) * {cells}L + {third * of} + pmod(shiftrightunsigned(xxhash64({key}, {cells}), {20 * third}), {of})"


def _entries(key: str, sign: str, blocks: str, cells: int) -> str:
    """SQL: what a digest adds to its three cells."""
    return ", ".join(f"named_struct('cell', {_cell(key, blocks, cells, j)}, 'n', {sign}, 'x', {key}, 'c', xxhash64({key}, 'check'))" for j in range(3))


def _added(rows: DataFrame, by: list[str]) -> DataFrame:
    """The cells (cell, n, x, c) that rows of entries add up to; empty ones go."""
    sums = [F.sum("e.n").alias("n"), F.expr("bit_xor(e.x)").alias("x"), F.expr("bit_xor(e.c)").alias("c")]
    return rows.groupBy(*by, F.col("e.cell").alias("cell")).agg(*sums).where("n != 0 or x != 0 or c != 0")


def blocks_of(count: str) -> str:
    """SQL: the number of blocks for so many digests of a text."""
    return f"cast(shiftleft(1, cast(ceil(log2(greatest(1D, {count} / {BLOCK}D))) as int)) as long)"


def peel(pairs: DataFrame, cells: int, rounds: int) -> DataFrame:
    """(row, pair, found, failed) of the pairs whose tables differ: the length of the digests recovered, and whether cells are left.

    ``pairs`` has the cells (cell, n, x, c) of the difference of each pair, and the number of blocks.
    """
    by = ["row", "pair", "blocks"]
    own = "named_struct('cell', cell, 'n', n, 'x', x, 'c', c)"
    for i in range(rounds):
        third = i % 3
        single = f"cell >= 0 and abs(n) = 1 and pmod(cell, {cells}) div {cells // 3} = {third} and c = xxhash64(x, 'check')"
        found = f"named_struct('cell', {FOUND}L, 'n', x & {LENGTH}L, 'x', 0L, 'c', 0L)"
        out = f"if({single}, array({own}, {_entries('x', '-n', 'blocks', cells)}, {found}), array({own}))"
        pairs = _added(pairs.select(*by, F.expr(f"explode({out})").alias("e")), by)
    return pairs.groupBy("row", "pair").agg(F.sum(F.when(F.col("cell") == FOUND, F.col("n")).otherwise(0)).alias("found"), F.max(F.col("cell") != FOUND).alias("failed"))


ROLES = {"a": 0, "ea": 1, "b": 2}  # digests of the text, of the edited text, of the next text
PAIRS = {"edited": ("a", "ea"), "next": ("a", "b")}


def stored(rows: DataFrame, of: tuple = tuple(ROLES)) -> DataFrame:
    """(row, role, blocks_a, blocks_ea, blocks_b, cell, n, x, c): the tables of the three texts of each row, or of some of them."""
    blocks = [F.expr(blocks_of(f"size({c})")).alias(f"blocks_{c}") for c in of]
    sets = ", ".join(f"named_struct('role', {ROLES[c]}, 'keys', {c}, 'own', blocks_{c})" for c in of)
    roles = rows.select("row", *of, *blocks).select("row", *(f"blocks_{c}" for c in of), F.expr(f"explode(array({sets}))").alias("r"))
    by = ["row", *(f"blocks_{c}" for c in of), "role"]
    keys = roles.select(*by[:-1], F.col("r.role").alias("role"), F.col("r.own").alias("own"), F.explode("r.keys").alias("k"))
    return _added(keys.select(*by, F.expr(f"explode(array({_entries('k', '1L', 'own', CELLS)}))").alias("e")), by)


def differences(tables: DataFrame) -> DataFrame:
    """The cells of the difference of each pair, those of the larger table folded to the blocks of the smaller."""
    sides = []
    for pair, (left, right) in PAIRS.items():
        blocks = f"least(blocks_{left}, blocks_{right})"
        cell = f"pmod(cell div {CELLS}, {blocks}) * {CELLS} + pmod(cell, {CELLS})"
        entry = "named_struct('pair', '{}', 'blocks', {}, 'cell', {}, 'n', {}, 'x', x, 'c', c)"
        sides.append(f"case role when {ROLES[left]} then {entry.format(pair, blocks, cell, 'n')} when {ROLES[right]} then {entry.format(pair, blocks, cell, '-n')} end")
    rows = tables.select("row", F.expr(f"explode(filter(array({', '.join(sides)}), s -> s is not null))").alias("e"))
    return _added(rows.select("row", "e.pair", "e.blocks", "e"), ["row", "pair", "blocks"])


def _found(peeled: DataFrame) -> DataFrame:
    """(row, edited, next): the length of the digests that each pair's peeling recovered, -1 if it failed, null if the tables were equal."""
    d = F.when(F.col("failed"), -1).otherwise(F.col("found"))
    return peeled.groupBy("row").agg(*(F.max(F.when(F.col("pair") == p, d)).alias(p) for p in PAIRS))


def _by_row(peeled: DataFrame, dealt: DataFrame) -> DataFrame:
    """(row, edited, next, a, ea, b): the digests only of rows of which a pair failed, so that a retry reads no others."""
    failed = " or ".join(f"{p} = -1" for p in PAIRS)
    keys = [F.expr(f"if({failed}, {c}, null)").alias(c) for c in ROLES]
    return _found(peeled).join(dealt, "row").select("row", *PAIRS, *keys)


def _again(peeled: DataFrame, parts: int) -> DataFrame:
    """(row, edited, next) of the failed pairs, by larger tables; the digests of those that fail again are compared as sets."""
    names = ", ".join(f"named_struct('pair', '{pair}', 'failed', {pair} = -1, 'left', {a}, 'right', {b})" for pair, (a, b) in PAIRS.items())
    failed = peeled.where(" or ".join(f"{p} = -1" for p in PAIRS)).repartition(parts, "row")
    pairs = failed.select("row", F.expr(f"explode(array({names}))").alias("p")).where("p.failed").select("row", "p.pair", "p.left", "p.right")
    found = written(peel(retried(pairs), RETRY_CELLS, RETRY_ROUNDS), "peeled-again")
    left = found.where("failed").select("row", "pair")
    if not left.isEmpty():
        exact = F.expr(total("concat(array_except(left, right), array_except(right, left))")).alias("found")
        sets = pairs.join(left, ["row", "pair"], "left_semi").select("row", "pair", exact, F.lit(False).alias("failed"))
        found = found.where("not failed").unionByName(sets)
    # tables that turn out equal leave no cells
    same = pairs.select("row", "pair", F.lit(0).cast("long").alias("found"), F.lit(False).alias("failed"))
    return _found(found.unionByName(same))


def retried(pairs: DataFrame) -> DataFrame:
    """The cells of the difference of the failed pairs' larger tables."""
    pairs = pairs.withColumn("blocks", F.expr(f"cast(greatest(1, ceil((size(left) + size(right)) / {RETRY_BLOCK}D)) as long)"))
    signed = "concat(transform(left, k -> named_struct('k', k, 'n', 1L)), transform(right, k -> named_struct('k', k, 'n', -1L)))"
    keys = pairs.select("row", "pair", "blocks", F.expr(f"explode({signed})").alias("s")).select("row", "pair", "blocks", "s.k", F.col("s.n").alias("sign"))
    by = ["row", "pair", "blocks"]
    return _added(keys.select(*by, F.expr(f"explode(array({_entries('k', 'sign', 'blocks', RETRY_CELLS)}))").alias("e")), by)


def texts_of(tables: DataFrame) -> DataFrame:
    """(row, fingerprint, edited_fingerprint): the number of blocks and the cells that are not empty, in hexadecimal digits."""
    cell = F.concat_ws(":", F.hex("cell"), F.hex("n"), F.hex("x"), F.hex("c"))
    listed = tables.where("role < 2").groupBy("row", "blocks_a", "blocks_ea").agg(*(F.collect_list(F.when(F.col("role") == i, F.struct("cell", cell.alias("text")))).alias(c) for c, i in ROLES.items() if i < 2))
    text = lambda c: F.concat(F.hex(f"blocks_{c}"), F.lit(";"), F.array_join(F.sort_array(c)["text"], ","))
    return listed.select("row", text("a").alias("fingerprint"), text("ea").alias("edited_fingerprint"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its last quarter (floor of the code points / 4) replaced
    by the first as many code points of the next document.
    """
    rows = with_next(docs, id_col, text_col).withColumn("n", F.length("t").cast("long"))
    rows = rows.withColumn("e", F.expr("concat(substring(t, 1, cast(n - n div 4 as int)), substring(next.t, 1, cast(n div 4 as int)))"))
    rows = rows.select("k", "n", "a", "e", F.col("next.a").alias("b"), F.expr(kept_digests("a", "n - n div 4")).alias("kept"))
    changed = digests("substring(e, cast(kept.at + 1 as int))")
    ea = f"array_distinct(concat(slice(a, 1, kept.n), {changed}))"
    sets = {"a": "array_distinct(a)", "ea": ea, "b": "array_distinct(b)"}
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "k", "n", F.sha2(F.col("e").cast("binary"), 256).alias("edited_sha256"), *(F.expr(s).alias(c) for c, s in sets.items()))
    sums = [F.expr(total(c)).alias(f"sum_{c}") for c in ROLES]
    rows = written(rows.select("*", *sums), "digests")
    parts = partitions(docs.sparkSession)
    dealt = rows.select("row", *ROLES).repartition(parts, "row")

    first = written(_by_row(peel(differences(stored(dealt)), CELLS, ROUNDS), dealt), "peeled-once")
    peeled = first.select("row", *PAIRS).unionByName(_again(first, parts)).groupBy("row").agg(*(F.max(p).alias(p) for p in PAIRS))
    peeled = written(peeled, "peeled")
    drop_written(first)  # with the digests of the failed pairs

    own = rows.select("row", "k", "n", "edited_sha256", *(f"sum_{c}" for c in ROLES)).repartition(parts, "row")
    told = own.join(texts_of(stored(dealt, ("a", "ea"))), "row", "left").join(peeled, "row", "left")
    empty = F.lit("1;")

    def near(pair: str) -> Column:
        left, right = PAIRS[pair]
        both, d = F.col(f"sum_{left}") + F.col(f"sum_{right}"), F.coalesce(pair, F.lit(0).cast("long"))
        return F.when(both == 0, 1.0).otherwise((both - d) / (both + d).cast("double"))

    return told.select(
        F.col("k").alias(id_col),
        F.col("n").alias("n_chars"),
        "edited_sha256",
        F.coalesce("fingerprint", empty).alias("fingerprint"),
        F.coalesce("edited_fingerprint", empty).alias("edited_fingerprint"),
        near("edited").alias("near_edited"),
        near("next").alias("near_next"),
    )
