"""Mixing sources to target weights: pivotal dependent rounding, in DataFrame functions only.

Every document of a source is wanted target / source_size times. The whole copies are certain; the fractions are rounded
by the pivotal method: two fractional units are paired, and a random amount of words moves from one to the other until one of them
is 0 or 1. Moves keep the expected copies of each document and, up to the one unit left, the words of the source. Units
are folded in blocks of about block_units; the unit that a block leaves goes to the next level of a reduction tree, in which
a block has at most block_units entries, until one unit a source is left, which is drawn by itself. Each level is written
to the shared folder, so its two readers do not repeat it.

Draws come from hashes of the two keys and texts, so reruns agree. Sources are ranked by code point (one row per source).

Defined cases: null texts have size 0; the null source is one source, last in rank; documents without words are taken 0
words; repeated rows count once each; ties in a block go by size, then key; an empty table gives no rows; extra
input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kernelfield.llm.common import WORD_SQL, plain_text, table, unused, written

EPS = 1e-9
_UNIT = "struct<size:bigint,doc_id:bigint,salt:bigint,whole:int,p:double,row:bigint>"
_DONE = f"array<{_UNIT}>"


def let(value: Column, then) -> Column:
    """then(value), with value evaluated once."""
    return F.transform(F.array(value), then)[0]


def source_targets(sized: DataFrame, cap: int = 3, cycle: int = 3) -> DataFrame:
    """source, docs, source_size, target: weights 1..cycle in rank order share the total; none is above cap times its size."""
    sources = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("w", ((F.row_number().over(by_name) - 1) % cycle + 1).cast("double")).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    everything = Window.partitionBy(F.lit(1))
    order = everything.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after)
    filled = ranked.withColumn("level", level).withColumn("capped", F.col("most") / F.col("w") < F.col("level")).withColumn("at", F.row_number().over(order))
    final = F.min(F.when(~F.col("capped"), F.struct("at", "level"))).over(everything)["level"]
    return filled.withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(F.least("most", final * F.col("w")))).select("source", "docs", "source_size", "target")


def _pair(a: Column, b: Column, level: int) -> Column:
    """Both units after words moved between them; one of them at least is whole."""
    up = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])
    down = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
    draw = F.pmod(F.xxhash64(F.lit(level), a["doc_id"], a["salt"], b["doc_id"], b["salt"]), F.lit(1 << 40)) / F.lit(float(1 << 40))
    moved = let(F.struct(up.alias("up"), down.alias("down")), lambda s: F.when(draw * (s["up"] + s["down"]) < s["down"], s["up"]).otherwise(-s["down"]))
    return let(moved, lambda m: F.array(a.withField("p", a["p"] + m / a["size"]), b.withField("p", b["p"] - m / b["size"])))


def _is_whole(x: Column) -> Column:
    return (x["p"] <= EPS) | (x["p"] >= 1 - EPS)


def _folded(units: DataFrame, level: int) -> DataFrame:
    """One row per source and block: left, the unit that stays fractional or null; done, the whole ones."""
    start = F.struct(F.lit(None).cast(_UNIT).alias("left"), F.array().cast(_DONE).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        def merged(two: Column) -> Column:
            rest = F.filter(two, lambda u: ~_is_whole(u))
            return F.struct(F.get(rest, F.lit(0)).alias("left"), F.concat(acc["done"], F.filter(two, _is_whole)).alias("done"))

        return F.when(acc["left"].isNull(), F.struct(x.alias("left"), acc["done"].alias("done"))).otherwise(let(_pair(acc["left"], x, level), merged))

    return units.groupBy("source", "block").agg(F.sort_array(F.collect_list("unit")).alias("units")).select("source", "block", F.aggregate("units", start, step).alias("s")).select("source", "block", "s.left", "s.done")


def _tree(units: DataFrame, most: int, block_units: int, label: int) -> tuple[list[DataFrame], DataFrame]:
    """Folds units level by level. Returns each level's table, and the last unit of each source: source, u, up."""
    states, level = [], 0
    while True:
        state = written(_folded(units, 64 * label + level), "pivotal")
        states.append(state)
        if most <= 1:
            break
        units = state.where(F.col("left").isNotNull()).select("source", F.floor(F.col("block") / block_units).alias("block"), F.col("left").alias("unit"))
        most, level = -(-most // block_units), level + 1
    draw = F.pmod(F.xxhash64(F.lit("last"), "u.doc_id", "u.salt"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return states, state.where(F.col("left").isNotNull()).select("source", F.col("left").alias("u")).select("source", "u", (draw < F.col("u.p")).cast("int").alias("up"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", cap: int = 3, cycle: int = 3, block_units: int = 64, tiers: tuple[int, ...] = (1024, 128), row: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken, row: one row per row of docs.

    Documents of more words than tiers[0] are rounded first, then those of more than tiers[1], and so on. What the last unit of a
    tier is off its expected words is taken from the fractions of the next tier, in proportion, so a source ends
    about a small document's size from its target. The column row is carried along (null without one); draws do not depend on it.
    """
    words = F.size(F.regexp_extract_all(plain_text(text), F.lit(WORD_SQL), F.lit(0))).cast("bigint")
    tier = sum(((F.col("size") <= t).cast("int") for t in tiers), F.lit(0))
    plain = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), words.alias("size"), F.xxhash64(plain_text(text)).alias("salt"), (F.col(row) if row else F.lit(None)).cast("bigint").alias("row"))
    sized = written(plain.withColumn("tier", tier), "sized")
    targets = written(source_targets(sized, cap, cycle), "targets")
    per_tier = written(sized.groupBy("source", "tier").agg(F.sum("size").alias("tier_size"), F.count("*").alias("n")), "tiers")
    most = {r[0]: r[1] for r in per_tier.groupBy("tier").agg(F.max("n")).collect()}
    wanted = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    near = F.when(F.abs(wanted - F.round(wanted)) < EPS, F.round(wanted)).otherwise(wanted)
    each = targets.withColumn("near", near).select(F.col("source").alias("of"), F.floor("near").cast("int").alias("whole"), (F.col("near") - F.floor("near")).alias("share"))
    off, settled = targets.select(F.col("source").alias("of"), F.lit(0.0).alias("off")), []
    for label in range(len(tiers) + 1):
        if label not in most:
            continue
        here = per_tier.where(F.col("tier") == label).join(each, F.col("source").eqNullSafe(F.col("of"))).drop("of").join(off, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        p = F.when((F.col("share") > EPS) & (F.col("share") < 1 - EPS) & (F.col("tier_size") > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("share") - F.col("off") / F.col("tier_size")))).otherwise(F.round("share"))
        plan = written(here.select(F.col("source").alias("of"), "whole", p.alias("p"), "n", (F.col("off") + (p - F.col("share")) * F.col("tier_size")).alias("off")), "plan")
        rows = sized.where(F.col("tier") == label).join(plan, F.col("source").eqNullSafe(F.col("of")))
        split = (F.col("size") > 0) & (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        blocks = F.greatest(F.ceil(F.col("n") / block_units), F.lit(1))
        units = rows.where(split).select("source", F.pmod(F.xxhash64(F.lit("block"), "doc_id", "salt"), blocks).alias("block"), F.struct("size", "doc_id", "salt", "whole", "p", "row").alias("unit"))
        settled.append(rows.where(~split).select("source", "doc_id", "row", "size", "whole", (F.col("p") > 0.5).cast("int").alias("up")))
        states, last = _tree(units, -(-most[label] // block_units), block_units, label)
        settled += [s.select("source", F.explode("done").alias("u")).select("source", "u.doc_id", "u.row", "u.size", "u.whole", (F.col("u.p") > 0.5).cast("int").alias("up")) for s in states]
        settled.append(last.select("source", "u.doc_id", "u.row", "u.size", "u.whole", "up"))
        over = last.select(F.col("source").alias("last_of"), ((F.col("up") - F.col("u.p")) * F.col("u.size")).alias("over"))
        changed = plan.join(over, F.col("of").eqNullSafe(F.col("last_of")), "left").select(F.col("of").alias("now_of"), (F.col("off") + F.coalesce("over", F.lit(0.0))).alias("now"))
        # a source without documents in this tier keeps what it was off
        off = written(off.join(changed, F.col("of").eqNullSafe(F.col("now_of")), "left").select("of", F.coalesce("now", "off").alias("off")), "off")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("up")).otherwise(0)
    totals = targets.select(F.col("source").alias("of"), "source_size", "target")
    every = sized.where(F.lit(False)).select("source", "doc_id", "row", "size", F.lit(0).alias("whole"), F.lit(0).alias("up"))
    for part in settled:
        every = every.unionByName(part)
    return every.join(totals, F.col("source").eqNullSafe(F.col("of")), "left").select("doc_id", "size", "source_size", "target", copies.cast("bigint").alias("copies"), (copies * F.col("size")).cast("bigint").alias("taken"), "row")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: each row as often as it is taken. Rows are told apart by a written number, as keys may be null or repeat."""
    row, of, copies, copy = (unused(x, docs) for x in ("__row", "__of", "__copies", "__copy"))
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    taken = mix(numbered, row=row).where(F.col("copies") > 0).select(F.col("row").alias(of), F.col("copies").cast("int").alias(copies))
    return numbered.join(taken, F.col(row) == F.col(of)).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)).drop(copy)
