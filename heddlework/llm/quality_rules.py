"""Quality rules whose thresholds come from mergeable quantile sketches.

Each document gives a few whole-number measures. For every language and source the values
of a measure are kept as a histogram with buckets of at most one sixteenth relative width:
a sketch that merges by adding counts, in any order, with the same result. A measure's
threshold is its median plus ``SPREAD`` times the distance from median to upper quartile
plus a slack, so it moves with what is normal in the group, up to the thresholds of its
language and of all rows, from the merged sketches. The thresholds are joined back
and a document goes if it breaks any of them or a base rule.

Null texts are empty; null languages and sources are a group of their own. Empty texts fail.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddlework.llm.common import per_row, text_bytes

SYMBOLS = b"#*$%&|<>"

#: Measure: (SQL over the counts, slack on top of the adaptive part). Shares are per mille.
MEASURES = {
    "symbols": ("1000 * n_symbols DIV greatest(word_chars, 1)", 25),
    "dup_lines": ("1000 * n_dup_lines DIV greatest(n_lines, 1)", 300),
    "repeats": ("1000 * n_repeat_words DIV greatest(n_words, 1)", 200),
    "shouts": ("1000 * n_shouts DIV greatest(n_words, 1)", 150),
    "word_length": ("100 * word_chars DIV greatest(n_words, 1)", 400),
}
SPREAD = 4
MIN_WORDS = 50

COUNTS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_lines bigint, n_shouts bigint"
)


def count_text(text: bytes) -> tuple[int, ...]:
    words = text.split()
    triples = list(zip(words, words[1:], words[2:], strict=False))
    repeats = 0
    if len(set(triples)) < len(triples):
        seen = Counter(triples)
        upto = 0  # words before this one are counted
        for at, triple in enumerate(triples):
            if seen[triple] > 1:
                repeats += at + 3 - max(at, upto)
                upto = at + 3
    lines = [line for line in text.split(b"\n") if line.strip()]
    joined = b"".join(words)
    return (
        len(words), len(joined) - len(joined.translate(None, STARTS)), len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)), repeats, len(lines), text.count(b"!"),
    )


#: Bytes that begin a code point.
STARTS = bytes(b for b in range(256) if not 0x80 <= b < 0xC0)


def with_counts(df: DataFrame, text: str = "text", into: str = "counts") -> DataFrame:
    return df.withColumn(into, per_row(lambda texts: map(count_text, texts), COUNTS)(text_bytes(F.col(text))))


def measures(counts: str | None = None) -> Column:
    """Array of (name, value) from count columns, or from those of a struct column."""
    def of(sql: str) -> Column:
        if counts:
            for name in (f.split()[0] for f in COUNTS.split(", ")):
                sql = sql.replace(name, f"{counts}.{name}")
        return F.expr(sql)

    return F.array(*[F.struct(F.lit(k).alias("measure"), of(sql).alias("value")) for k, (sql, _) in MEASURES.items()])


def bucket(value: Column) -> Column:
    """Lower end of the value's bucket: exact below 32, then 16 buckets for each power of two."""
    cut = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, cut), cut)


def sketches(values: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of (keys, measure, value) as histograms: (keys, measure, bucket, n)."""
    return values.groupBy(*keys, "measure", bucket(F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of fewer keys, without the rows behind them."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], wanted: dict[str, float]) -> DataFrame:
    """For each group and measure the bucket in which each wanted share of its values ends."""
    group = Window.partitionBy(*keys, "measure")
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(group)})
    return ranked.groupBy(*keys, "measure").agg(
        *[F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bucket"))).alias(name) for name, q in wanted.items()]
    )


def limits(sketch: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, measure, name): the largest value that a group's own quantiles let pass."""
    slack = F.create_map(*[F.lit(x) for k, (_, s) in MEASURES.items() for x in (k, s)])
    cut = F.col("q50") + F.lit(SPREAD) * (F.col("q75") - F.col("q50")) + slack[F.col("measure")]
    found = quantiles(sketch, keys, {"q50": 0.5, "q75": 0.75})
    return found.select(*keys, "measure", cut.cast("bigint").alias(name))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row for each language and source with a map of measure to the largest value that passes.

    A group of which more than a quarter is bad, or of a few rows, sets no limit of use by
    itself. So its limits are at most those of its language and, for shares,
    which do not depend on the language's words, of all rows; these come from the merged sketch.
    """
    keys = ["g_lang", "g_source"]
    own = limits(sketch, keys, "cut")
    by_lang = limits(merge(sketch, ["g_lang"]), ["g_lang"], "lang_cut")
    by_lang = by_lang.withColumnsRenamed({"g_lang": "l_lang", "measure": "l_measure"})
    overall = limits(merge(sketch, []), [], "all_cut").withColumnRenamed("measure", "a_measure")
    own = own.join(by_lang, _same(own, by_lang, {"g_lang": "l_lang", "measure": "l_measure"}))
    own = own.join(overall, F.col("measure") == F.col("a_measure"))
    shares = F.when(F.col("measure") != "word_length", F.col("all_cut"))
    own = own.withColumn("cut", F.least("cut", "lang_cut", shares))
    return own.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("measure", "cut"))).alias("cuts"))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)


def broken(values: Column, cuts: Column) -> Column:
    """Names of the measures above their thresholds, in order of name."""
    over = F.filter(values, lambda m: m["value"] > cuts[m["measure"]])
    return F.array_sort(F.transform(over, lambda m: m["measure"]))


def _same(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    condition = F.lit(True)
    for a, b in keys.items():
        condition &= left[a].eqNullSafe(right[b])
    return condition


def quality_table(docs: DataFrame, stage) -> DataFrame:
    """doc_id, the counts, base_failed, failed_rules and kept, one row for each document.

    The counts are written once; sketch and filter read them without the texts.
    """
    counted = with_counts(docs.select("doc_id", "text", "lang", "source"))
    counts = stage.put(counted.select("doc_id", "lang", "source", "counts.*"), "counts")
    return judged(counts.withColumn("values", measures()), group_cuts(counts, stage))


def group_cuts(counts: DataFrame, stage) -> DataFrame:
    values = counts.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.inline(measures()))
    sketch = stage.put(sketches(values, ["g_lang", "g_source"]), "sketches")
    return stage.put(thresholds(sketch), "thresholds")


def judged(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    joined = rows.join(cuts, _same(rows, cuts, {"lang": "g_lang", "source": "g_source"}))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    out = joined.withColumns({"base_failed": failed, "failed_rules": broken(F.col("values"), F.col("cuts"))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed_rules", ",").alias("failed_rules"),
    )


def quality_filter(docs: DataFrame, stage) -> DataFrame:
    """The documents that pass, with their own columns.

    The texts are counted again rather than joined by id, so ids may repeat and no text
    has to be shuffled while Spark finds the thresholds small enough to broadcast.
    """
    row = docs.select(F.struct("*").alias("row"))
    counted = with_counts(row.withColumn("text", F.col("row.text"))).drop("text")
    counts = stage.put(
        counted.select(F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), "counts.*"), "counts"
    )
    cuts = group_cuts(counts, stage)
    rows = counted.select(
        "row", F.col("row.lang").alias("lang"), F.col("row.source").alias("source"),
        measures("counts").alias("values"), "counts.n_words", "counts.n_repeat_words",
    )
    joined = rows.join(cuts, _same(rows, cuts, {"lang": "g_lang", "source": "g_source"}))
    passes = ~base_failed(F.col("n_words"), F.col("n_repeat_words")) & (
        F.size(broken(F.col("values"), F.col("cuts"))) == 0
    )
    return joined.where(passes).select("row.*")
