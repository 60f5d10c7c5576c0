"""Mixing sources to target weights by Pareto order sampling, in built-in functions only.

A source's target is its share of the wanted total by weight, stopped at ``CAP`` times its
size, the excess going to the others by weight (the level is found by sorting sources by the
level at which they fill up). A document expects target / size copies. The whole part is
certain: every document gets that many copies. The words that are left of a target go to a
sample of unequal probabilities: a document is included with p = min(1, c b), where b is its
size rounded down to a sixteenth and c is solved for each source so that the expected words
are the words left. Documents of p = 1 are certain. The others are ranked in Pareto order,
by a uniform number's odds u / (1 - u) over the inclusion odds p / (1 - p), and taken in that
order until the words left are used up, so the size of a sample is fixed in words.

A document larger than the words left takes no part. Where the next document no longer
fits, the draw goes on in the same order among those that still fit, until none does; each
round takes at least one document of every source still open. Where more than half of a
source's words are left to take, the smaller rest can be met more closely: the documents
that stay out are drawn, from the far end of the same order.

u is a hash of id, size and seed, so reruns agree. Ranks r are cut into ``BINS`` bins of
r / (1 + r); sizes are summed by bin before the shuffle, and only the documents of the one bin
in which a source runs out are put in order, which splits a source that holds a third of all
rows: a sample runs out near r = 1, where a bin is at most 1 / ``BINS`` wide in u.

Null texts and empty texts have size 0 and are taken as certain copies of 0 words. Null
sources are one source, the last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddlework.llm.common import WORD
from heddlework.llm.quality_rules import bucket

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BINS = 4096
SEED = "mix"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(doc_id: Column, size: Column, seed: str = SEED) -> Column:
    """A number between 0 and 1, both excluded, from the first 48 bits of a digest."""
    word = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string"), F.lit(seed))
    first = F.conv(F.substring(F.md5(word.cast("binary")), 1, 12), 16, 10).cast("bigint")
    return (first + F.lit(0.5)) / F.lit(float(1 << 48))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, size) with weight, target; ``sizes`` has one row for each source.

    The sources, not their documents, meet in one window.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("bigint"))
    rows = rows.withColumn("fills_at", CAP * F.col("source_size") / F.col("weight"))
    everything = Window.partitionBy(F.lit(0))
    by_level = Window.orderBy(F.col("fills_at"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_level.rowsBetween(0, Window.unboundedFollowing)
    total = SHARE * F.sum("source_size").over(everything)
    full = CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rows = rows.withColumn("level", (total - full) / F.sum("weight").over(onwards))
    # The first source, by level, that does not fill up sets the level of all after it.
    open_ = F.when(F.col("fills_at") > F.col("level"), F.struct(F.row_number().over(by_level).alias("place"), "level"))
    rows = rows.withColumn("open", open_).withColumn("level", F.min("open").over(everything)["level"])
    capped = F.col("level").isNull() | (F.col("fills_at") <= F.col("level"))
    target = F.when(capped, (CAP * F.col("source_size")).cast("double")).otherwise(F.col("level") * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def inclusion_scales(rows: DataFrame) -> DataFrame:
    """(source, scale): inclusion is min(1, scale x step); ``rows``: source, step, size, words_left, stay_out.

    Sizes meet by step, at most sixteen for each power of two, so a source is a small window.
    """
    steps = rows.groupBy("source", "words_left", "stay_out", "step").agg(F.sum("size").alias("words"))
    down = Window.partitionBy("source").orderBy(F.col("step").desc())
    larger, rest = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(0, Window.unboundedFollowing)
    # Decimal sums: the same in every order.
    squares = F.sum(F.col("step").cast("decimal(19,0)") * F.col("words").cast("decimal(19,0)")).over(rest)
    steps = steps.withColumns({
        "all_words": F.sum("words").over(Window.partitionBy("source")),
        "certain_words": F.coalesce(F.sum("words").over(larger), F.lit(0)), "squares": squares.cast("double"),
    })
    wanted = F.when(F.col("stay_out"), F.col("all_words") - F.col("words_left")).otherwise(F.col("words_left"))
    scale = F.when(wanted >= F.col("all_words"), 1.0).when(wanted <= 0, 0.0).otherwise((wanted - F.col("certain_words")) / F.col("squares"))
    # The largest step that is not certain itself gives the scale; all larger ones are.
    open_ = steps.withColumn("scale", scale).where(F.col("scale") * F.col("step") <= 1)
    return open_.groupBy("source").agg(F.max_by("scale", "step").alias("scale"))


def _draw(rows: DataFrame, stage, name: str) -> DataFrame:
    """Mark ``extra`` for the documents of one round; all of ``rows`` fit into ``left`` of their source."""
    by_bin = rows.groupBy("source", "left", "bin").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ends = by_bin.withColumn("upto", F.sum("words").over(upto)).where(F.col("upto") > F.col("left"))
    ends = ends.groupBy("source").agg(
        F.min("bin").alias("last_bin"), F.min_by(F.col("upto") - F.col("words"), "bin").alias("words_before")
    )
    ends = stage.put(ends, f"{name}-ends").withColumnRenamed("source", "end_source")
    joined = rows.join(ends, F.col("source").eqNullSafe(F.col("end_source")), "left").drop("end_source")
    at_end = F.coalesce(F.col("bin") == F.col("last_bin"), F.lit(False))
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    settled = joined.where(~at_end).withColumn("extra", F.col("last_bin").isNull() | (F.col("bin") < F.col("last_bin")))
    ordered = joined.where(at_end).withColumn("extra", F.col("words_before") + F.sum("size").over(order) <= F.col("left"))
    return settled.unionByName(ordered).select(*rows.columns, "extra")


def mix(docs: DataFrame, stage, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken, one row for each document."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return draw(stage.put(sized, "sized"), stage, seed)


def draw(sized: DataFrame, stage, seed: str = SEED) -> DataFrame:
    """``mix`` from rows of (doc_id, source, size); further columns are kept."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = stage.put(targets(sizes), "targets").withColumnRenamed("source", "t_source")
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1)
    rows = rows.withColumn("certain", copies.cast("bigint"))
    left = F.col("target") - F.col("certain") * F.col("source_size")
    # Of more than half of a source the smaller rest is drawn: those that stay out.
    rows = rows.withColumn("stay_out", left > 0.5 * F.col("source_size"))
    rows = rows.withColumn("words_left", F.when(F.col("stay_out"), F.col("source_size") - left).otherwise(left))
    rows = rows.withColumn("step", F.when((F.col("size") > 0) & (F.col("size") <= F.col("words_left")), bucket(F.col("size"))))
    scales = inclusion_scales(rows.where("step IS NOT NULL"))
    scales = stage.put(scales, "scales").withColumnRenamed("source", "s_source")
    rows = rows.join(scales, F.col("source").eqNullSafe(F.col("s_source")), "left").drop("s_source")
    # Null for those that take no part.
    share = F.col("scale") * F.col("step")
    taken_in, u = F.when(share > 1, 1.0).otherwise(share), uniform(F.col("doc_id"), F.col("size"), seed)
    rows = rows.withColumns({
        "p": F.when(F.col("stay_out"), 1 - taken_in).otherwise(taken_in), "u": F.when(F.col("stay_out"), 1 - u).otherwise(u),
    })
    ours, others = F.col("u") * (1 - F.col("p")), (1 - F.col("u")) * F.col("p")
    rows = rows.withColumn("rank", ours / (ours + others))
    certain_bin = F.when(F.col("p") >= 1, -1).otherwise(F.floor(F.col("rank") * BINS)).cast("bigint")
    rows = rows.withColumn("bin", certain_bin).drop("step", "scale", "u").withColumnRenamed("words_left", "left")
    rows = stage.put(rows, "ranked")
    takes_part = F.coalesce(F.col("p") > 0, F.lit(False))
    done, open_, k = [rows.where(~takes_part).withColumn("extra", F.lit(False))], rows.where(takes_part), 0
    while not open_.isEmpty():
        drawn = stage.put(_draw(open_, stage, f"round-{k}"), f"round-{k}")
        used = drawn.where("extra").groupBy("source").agg(F.sum("size").alias("used"))
        used = stage.put(used, f"used-{k}").withColumnRenamed("source", "u_source")
        after = drawn.join(used, F.col("source").eqNullSafe(F.col("u_source")), "left")
        after = after.withColumn("left", F.col("left") - F.coalesce("used", F.lit(0))).drop("u_source", "used")
        goes_on = ~F.col("extra") & (F.col("size") <= F.col("left"))
        done.append(after.where(~goes_on))
        open_, k = after.where(goes_on).drop("extra"), k + 1
    rows = reduce(DataFrame.unionByName, done)
    copies = F.col("certain") + (F.col("extra") != F.col("stay_out")).cast("bigint")
    return rows.withColumns({"copies": copies, "taken": copies * F.col("size")}).drop(
        "certain", "left", "extra", "stay_out", "p", "rank", "bin"
    )


def mixed_documents(docs: DataFrame, stage, seed: str = SEED) -> DataFrame:
    """The documents of the mix, with their own columns, as often as they are taken.

    Copies are decided on (doc_id, source, size) and joined back by them. Rows that agree in
    these three are told apart by their number among themselves, and swapping them changes
    no total.
    """
    key = ["doc_id", "source", "size"]
    keyed = docs.select(F.struct("*").alias("row")).select(
        "row", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), n_words(F.col("row.text")).alias("size")
    )
    narrow = stage.put(keyed.select(*key), "sized")
    decided = draw(narrow, stage, seed).groupBy(*key).agg(
        F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")
    )
    decided = stage.put(decided, "decided").select(*[F.col(k).alias(f"d_{k}") for k in key], "copies", "rows")
    same = F.lit(True)
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"d_{k}"))
    # In memory a row takes many times what its file tells, so this is not for a broadcast.
    joined = keyed.join(decided.hint("merge"), same)
    # Copies of a key beyond an even share go to its first rows by hash of the text.
    single = joined.where("rows = 1").select("row", "copies")
    order = Window.partitionBy(*[f"d_{k}" for k in key]).orderBy(F.xxhash64("row.text"))
    share = F.expr("copies DIV rows") + (F.row_number().over(order) <= F.col("copies") % F.col("rows")).cast("bigint")
    several = joined.where("rows > 1").withColumn("copies", share).select("row", "copies")
    taken = single.unionByName(several).where("copies > 0")
    return taken.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")
