"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Every document should be taken target / source size times on average. The whole part is taken as it is;
the fractions are rounded by the pivotal method: two fractions meet, mass moves at random from one to the
other until one is 0 or 1, and the other goes on. Documents meet in chunks of similar size, so that the
words taken stay close to the target; what each chunk has left over goes on in the next level of a
reduction tree, until one chunk remains per source.

Defined results: a null text has size 0; the null source is a source of its own, after all others; a
source without words has target 0; equal rows are told apart by their place among rows with the same id,
source and text; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.session import RunFolder
from topicloom.sources.corpus import dense_ids

CHUNK = 128
MOST_COPIES = 3.0
SEED = 20_240_601
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sized: DataFrame, run: RunFolder, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """``source, source_size, target``: all sizes shared by weight, no source above three times its own."""
    sums = run.write(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = dense_ids(sums.where("source IS NOT NULL"), "source", "_rank", run).select("source", "source_size", "_rank")
    last = sums.where("source IS NULL").select("source", "source_size", F.lit(ranked.count()).cast("bigint").alias("_rank"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = run.write(
        ranked.unionByName(last).select("source", "source_size", weight.alias("w"), (MOST_COPIES * F.col("source_size")).alias("cap")),
        "weighted",
    )
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double").alias("t")).first().t
    level, full = 0.0, -1
    while True:
        over = F.lit(level) * F.col("w") >= F.col("cap")
        now = table.agg(
            F.count(F.when(over, 1)).alias("n"),
            F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)).alias("cap"),
            F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0)).alias("w"),
        ).first()
        if now.n == full or not now.w:
            break
        full, level = now.n, (total - now.cap) / now.w
    return table.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("w")).alias("target"))


def _meet() -> Column:
    """Fold a chunk: the held unit meets one after another; each meeting settles one of the two."""
    total, low = "(acc.held.p + x.p)", "(acc.held.p + x.p < 1D)"
    draw = f"(pmod(xxhash64(acc.held.h, x.h, {SEED}L), 9007199254740992L) / 9007199254740992D)"
    chance = f"IF({low}, coalesce(try_divide(acc.held.p, {total}), 0D), coalesce(try_divide(1D - x.p, 2D - {total}), 0D))"
    settles_x = f"({low} = ({draw} < {chance}))"
    unit = "struct<size: bigint, h: bigint, doc_id: bigint, place: int, p: double>"
    settled = f"IF({settles_x}, x, acc.held)"
    goes_on = f"IF({settles_x}, acc.held, x)"
    left = f"({total} - IF({low}, 0D, 1D))"
    carry = f"named_struct('size', {goes_on}.size, 'h', {goes_on}.h, 'doc_id', {goes_on}.doc_id, 'place', {goes_on}.place, 'p', {left})"
    done = f"named_struct('size', {settled}.size, 'doc_id', {settled}.doc_id, 'place', {settled}.place, 'more', IF({low}, 0, 1))"
    return F.expr(
        "aggregate(slice(units, 2, size(units)), named_struct("
        "'done', cast(array() AS array<struct<size: bigint, doc_id: bigint, place: int, more: int>>), "
        f"'held', cast(units[0] AS {unit})), "
        f"(acc, x) -> named_struct('done', concat(acc.done, array({done})), 'held', {carry}))"
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, place, source, size, source_size, target, copies, taken`` of every row of ``docs``."""
    run = RunFolder(docs.sparkSession, "mix")
    keyed = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.xxhash64(source, text).alias("_text"),
    )
    sized = run.write(keyed.withColumn("place", _place("doc_id", "_text")).drop("_text"), "sized")
    targets = run.write(source_targets(sized, run), "targets")
    share = F.least(F.lit(MOST_COPIES), F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)))
    band = F.floor(F.log2(F.col("size") + 1) * 4).cast("int")
    # null sources do not meet in an equality join: they take part under a flag and an empty name
    named = lambda d: d.withColumn("_null", F.col("source").isNull()).fillna("", ["source"])
    groups = (
        named(sized).groupBy("_null", "source", band.alias("band")).agg(F.ceil(F.count("*") / CHUNK).alias("m"))
    ).join(named(targets), ["_null", "source"])
    h = F.xxhash64("doc_id", "place", "size")
    units = (
        named(sized)
        .withColumn("band", band)
        .join(groups, ["_null", "source", "band"])
        .select(
            "_null", "source", "source_size", "target", "band",
            F.pmod(F.xxhash64(h, F.lit(0)), F.col("m")).alias("chunk"),
            F.struct("size", h.alias("h"), "doc_id", "place", (share - F.floor(share)).alias("p")).alias("unit"),
        )
    )
    origin = ["_null", "source", "source_size", "target"]
    settled, level = [], 0
    while True:
        folded = run.write(
            units.groupBy(*origin, "band", "chunk")
            .agg(F.array_sort(F.collect_list("unit")).alias("units"))
            .select(*origin, _meet().alias("r")),
            f"level-{level}",
        )
        settled.append(folded.select(*origin, F.explode("r.done").alias("d")).select(*origin, "d.*"))
        left = folded.select(*origin, F.col("r.held").alias("unit"))
        sizes = run.write(
            left.groupBy("_null", "source").agg(F.count("*").alias("n"), F.ceil(F.count("*") / CHUNK).alias("m")), f"left-{level}"
        )
        level += 1
        if sizes.where("n > 1").isEmpty():
            break
        units = left.join(sizes, ["_null", "source"]).select(
            *origin,
            F.lit(0).alias("band"),
            F.pmod(F.xxhash64("unit.h", F.lit(level)), F.col("m")).alias("chunk"),
            "unit",
        )
    draw = F.pmod(F.xxhash64("unit.h", F.lit(SEED)), F.lit(1 << 53)) / float(1 << 53)
    settled.append(
        left.select(*origin, "unit.size", "unit.doc_id", "unit.place", (draw < F.col("unit.p")).cast("int").alias("more"))
    )
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    copies = F.floor(share).cast("bigint") + F.col("more")
    return out.select(
        "doc_id", "place", F.when(~F.col("_null"), F.col("source")).alias("source"), "size", "source_size", "target",
        copies.alias("copies"), (F.col("size") * copies).alias("taken"),
    )


def _place(doc_id: str, text_hash: str) -> Column:
    """The place of a row among those with its id."""
    return F.row_number().over(Window.partitionBy(doc_id).orderBy(text_hash)) - 1


def take(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` takes it, with whatever columns they have."""
    # the row is one value, so no column of it can meet a helper column
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = whole.select("row", F.col("row.doc_id").cast("bigint").alias("id"), F.xxhash64("row.source", "row.text").alias("hash"))
    rows = keyed.select("row", F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("no_id"), _place("id", "hash").alias("place"))
    chosen = mixed.where("copies > 0").select(
        F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "place", F.col("copies").cast("int").alias("copies")
    )
    taken = rows.join(chosen, ["id", "no_id", "place"]).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select("row.*")
