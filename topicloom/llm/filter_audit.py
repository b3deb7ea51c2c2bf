"""Filter interaction audit: what every filter removes, and for whom, in every order of applying them.

A document is reduced to a mask of the filters it fails. Documents with equal part and mask form a cell, so
there are at most ``2 ** filters`` cells a part, whatever the number of documents. Each cell folds along
every order with ``aggregate`` inside ``transform``: one struct of counts for each order and step (600 for
five filters), weighted by the size of the cell. The arrays of the cells of a part are added up element by
element. Nothing but cells is ever gathered, and nothing reaches the driver.

Exact copies are found by the SHA-256 of the text: the smallest id of each text is taken with partial sums
before the shuffle, then met again by text *and* id, so a text that a third of all rows share is spread like
any other.

Defined results: a null text is the empty text; a null part is the part ""; a row without an id is never a
copy, makes no copies and has no labels; rows with equal id and text are not copies of each other; a
document with several label rows is good (or toxic) if one of them says so; labels of unknown documents do
nothing; other columns are ignored; an empty table has no parts and gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.session import RunFolder

SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
# Rows without an id match no label; this many parts keep them from meeting in one task.
SPREAD = 1024


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions by letter: short, repetitive, upper-case, symbols."""
    words = F.array_remove(F.split(text, SPACE), "")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, filters: dict[str, Column], part: str, doc_id: str, text: str) -> DataFrame:
    """``id, part, digest, mask``: bit i of the mask is set where the i-th filter fails."""
    whole = docs.select(
        F.col(doc_id).cast("bigint").alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        # plain sums, not branches: the words of a text are then found once for all filters
        mask = mask + F.coalesce(fails, F.lit(False)).cast("int") * (1 << i)
    return whole.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def mark_copies(rows: DataFrame, bit: int) -> DataFrame:
    """``rows`` with ``bit`` added to the masks of those whose text stands under a smaller id."""
    known = rows.where("id IS NOT NULL")
    first = known.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    joined = rows.join(first, ["digest", "id"], "left")
    return joined.select("id", "part", "digest", F.when(copy, F.col("mask") + bit).otherwise(F.col("mask")).alias("mask"))


def cells(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``part, mask, n, good, toxic`` of masked rows."""
    marks = labels.select(
        F.col(doc_id).cast("bigint").alias("id"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int").alias("good"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int").alias("toxic"),
    ).where("id IS NOT NULL")
    marks = marks.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    salt = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SPREAD))).otherwise(F.lit(0)).cast("int")
    joined = rows.withColumn("salt", salt).join(marks.withColumn("salt", F.lit(0)), ["id", "salt"], "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def fold_orders(cell: DataFrame, letters: str) -> DataFrame:
    """``part, filter_order, step`` with COUNTS and ``shapley``, for all orders of ``letters``."""
    orders = ["".join(p) for p in permutations(letters)]
    k = len(letters)
    bits = lambda order: "array(" + ", ".join(str(1 << letters.index(c)) for c in order) + ")"
    order_array = "array(" + ", ".join(bits(o) for o in orders) + ")"
    kind = "array<struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">>"

    fails, before = "(mask & b) <> 0", "(mask & s.before) <> 0"
    entry = f"""named_struct(
        'kept', if((mask & (s.before | b)) = 0, n, 0L),
        'removed', if({fails} AND NOT {before}, n, 0L),
        'redundant', if({fails} AND {before}, n, 0L),
        'unique_fails', if(mask = b, n, 0L),
        'good_lost', if({fails} AND NOT {before}, good, 0L),
        'toxic_lost', if({fails} AND NOT {before}, toxic, 0L))"""
    fold = f"""flatten(transform({order_array}, o -> aggregate(
        o, named_struct('before', 0, 'steps', cast(array() AS {kind})),
        (s, b) -> named_struct('before', s.before | b, 'steps', concat(s.steps, array({entry}))),
        s -> s.steps)))"""
    added = "named_struct(" + ", ".join(f"'{c}', x.{c} + y.{c}" for c in COUNTS) + ")"
    nothing = "named_struct(" + ", ".join(f"'{c}', 0L" for c in COUNTS) + ")"
    merged = f"aggregate(folded, cast(array_repeat({nothing}, {len(orders) * k}) AS {kind}), (a, f) -> zip_with(a, f, (x, y) -> {added}))"
    # removed by each filter over all orders, in the order of the letters
    at = f"flatten({order_array})"
    shares = f"transform({bits(letters)}, b -> aggregate(zip_with(steps, {at}, (x, c) -> if(c = b, x.removed, 0L)), 0L, (s, x) -> s + x))"

    parts = cell.select("part", F.expr(fold).alias("steps")).groupBy("part").agg(F.collect_list("steps").alias("folded"))
    sums = parts.select("part", F.expr(merged).alias("steps"))
    rows = sums.select("part", F.expr(shares).alias("shares"), F.posexplode("steps").alias("place", "c"))
    order = F.element_at(F.lit(orders), (F.floor(F.col("place") / k) + 1).cast("int"))
    step = (F.col("place") % k + 1).cast("int")
    named = rows.select("part", order.alias("filter_order"), step.alias("step"), "shares", *[f"c.{c}" for c in COUNTS])
    which = F.instr(F.lit(letters), F.substring("filter_order", F.col("step"), F.lit(1)))
    return named.select("part", "filter_order", "step", *COUNTS, F.element_at("shares", which).alias("shapley"))


def audit(
    docs: DataFrame,
    labels: DataFrame,
    filters: dict[str, Column] | None = None,
    copies: str | None = "E",
    part: str = "lang",
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The audit of ``filters`` (failure conditions on a column ``text``, by letter) over ``docs``.

    ``copies`` is the letter of one more filter, which fails a text that also stands under a smaller id.
    """
    filters = filters if filters is not None else text_filters(F.col("text"))
    run = RunFolder(docs.sparkSession, "audit")
    rows = run.write(masks(docs, filters, part, doc_id, text), "masks")
    letters = "".join(filters)
    if copies:
        rows, letters = mark_copies(rows, 1 << len(letters)), letters + copies
    return fold_orders(cells(rows, labels), letters)


# The audit as plain SQL: every order and step is joined to every cell.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                 max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
masked AS (
  SELECT d.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
         CASE WHEN len(w) < 100 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(d.t) - length(regexp_replace(d.t, '[A-Z]', '', 'g'))) > 10 * length(d.t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN d.doc_id > f.first THEN 16 ELSE 0 END AS mask
  FROM d JOIN firsts f ON d.t = f.t LEFT JOIN marks m ON d.doc_id = m.doc_id),
cell AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masked GROUP BY part, mask),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (
  SELECT v.l || w.l || x.l || y.l || z.l AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bits
  FROM letter v, letter w, letter x, letter y, letter z
  WHERE v.b + w.b + x.b + y.b + z.b = 31 AND (v.b | w.b | x.b | y.b | z.b) = 31),
steps AS (
  SELECT filter_order, s AS step, bits[s] AS b, coalesce(list_sum(bits[1:s - 1]), 0)::BIGINT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
counted AS (
  SELECT part, filter_order, step, b,
    sum(CASE WHEN (mask & (before | b)) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN (mask & b) <> 0 AND (mask & before) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN (mask & b) <> 0 AND (mask & before) <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = b THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN (mask & b) <> 0 AND (mask & before) = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN (mask & b) <> 0 AND (mask & before) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cell, steps GROUP BY part, filter_order, step, b)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley
FROM counted
"""
