"""Mixing sources to target weights (operator 5), in DataFrame functions only.

Sources get budgets in words by weight; documents get hash-random keys, are
sorted by key within their source in key ranges, and a prefix sum of their
sizes cuts each source exactly at its budget. Whole epochs are repeated first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK_CLASS, BLANKS, row_struct, word_count, write_table

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix holds so many times the words of all sources.
SHARE = 1.5
#: No source, and no document, is taken more often.
MAX_EPOCHS = 2
#: Seed of the documents' keys.
SEED = 17
#: Key ranges of about so many documents are sorted together.
RANGE_ROWS = 4_096
#: Equal rows are counted and come back in portions of so many.
PORTION_ROWS = 4_096
_PREFIX_DIGITS = 7


def random_key(doc_id: Column, seed: int) -> Column:
    """A random-looking key that is the same in every run: MD5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def source_targets(
    sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights go by code-point order, null last. A target stops at ``max_epochs``
    times its source's size and the excess is shared again by weight until none
    is above. That ends at min(cap, level * weight), where the level follows
    from the sources sorted by cap / weight. The table has one row per source.
    """
    ranked = sizes.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    )
    table = F.array(*(F.lit(float(w)) for w in weights))
    caps = ranked.select(
        "source",
        "source_size",
        F.element_at(table, (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"),
    )
    full = Window.partitionBy(F.lit(0))
    order = full.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = caps.select(
        "*",
        (
            (F.sum(F.col("source_size").cast("double")).over(full) * F.lit(float(share))
             - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            / F.sum("weight").over(onward)
        ).alias("try"),
    )
    level = F.max(F.when(F.col("try") <= F.col("cap") / F.col("weight"), F.col("try"))).over(full)
    return levels.select(
        "source",
        "source_size",
        F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight")).alias("target"),
    )


def placed_ties(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Per doc_id, source and size: n, the rows of ``docs`` that agree in them, with key,
    source_size, target, epochs, and left: the words of the last epoch that are left for
    them and those after them in the order key, doc_id, size.

    Such rows are counted before the sort, so an id (or a null one) that a third of all
    rows share is one row of its key range.
    """
    # the text is read once; only ids and sizes go on
    sized = write_table(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes"
    )
    digits = F.lit(16**_PREFIX_DIGITS)
    sources = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("source_docs")
    )
    targets = write_table(
        source_targets(sources.select("source", "source_size"), weights, share, max_epochs)
        .alias("t")
        .join(sources.select(F.col("source").alias("s"), "source_docs").alias("n"),
              F.col("t.source").eqNullSafe(F.col("n.s")))
        .select(
            F.col("t.source").alias("source"),
            "source_size",
            "target",
            F.ceil(F.col("source_docs") / F.lit(range_rows)).alias("ranges"),
        ),
        "targets",
    )
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    keyed = (
        sized.alias("d")
        .join(targets.alias("t"), same("d", "t"))
        .select(
            "d.doc_id", "d.source", "d.size", "t.source_size", "t.target", "t.ranges",
            random_key(F.col("d.doc_id"), seed).alias("key"),
        )
        .withColumn(
            "range",
            F.floor(F.conv(F.substring("key", 1, _PREFIX_DIGITS), 16, 10).cast("long") * F.col("ranges") / digits),
        )
    )
    tied = write_table(
        keyed.groupBy("source", "range", "key", "doc_id", "size", "source_size", "target").agg(F.count("*").alias("n")), "tied"
    )
    together = F.col("size") * F.col("n")
    ranges = tied.groupBy("source", "range").agg(F.sum(together).alias("words"))
    base = ranges.select(
        "source",
        "range",
        F.coalesce(
            F.sum("words").over(
                Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("base"),
    )
    placed = (
        tied.alias("k")
        .join(base.alias("b"), same("k", "b") & (F.col("k.range") == F.col("b.range")))
        .select("k.*", "b.base")
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    budget = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    left = F.greatest(F.lit(0), budget - F.col("epochs") * F.col("source_size") - F.col("prefix"))
    return (
        placed.withColumn("prefix", F.col("base") + F.coalesce(F.sum(together).over(inside), F.lit(0)))
        .withColumn("epochs", epochs.cast("long"))
        .withColumn("left", left.cast("long"))
    )


def tie_takes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and rows: how many of the rows
    of ``docs`` that agree in doc_id, source and size are taken alike."""
    # of equal rows the first ones are whole, the next gives what is missing
    whole = F.when(F.col("size") > 0, F.least(F.col("n"), F.floor(F.col("left") / F.col("size")))).otherwise(F.lit(0))
    portion = lambda rows, more: F.struct(
        rows.cast("long").alias("rows"), (F.col("epochs") * F.col("size") + more).cast("long").alias("taken")
    )
    portions = F.array(
        portion(F.col("whole"), F.col("size")),
        portion(F.least(F.lit(1), F.col("n") - F.col("whole")), F.least(F.col("size"), F.col("left") - F.col("whole") * F.col("size"))),
        portion(F.col("n") - F.col("whole") - 1, F.lit(0)),
    )
    return write_table(
        placed_ties(docs, **options)
        .withColumn("whole", whole.cast("long"))
        .withColumn("portion", F.explode(F.filter(portions, lambda p: p["rows"] > 0)))
        .select("doc_id", "source", "size", "source_size", "target", "portion.taken", "portion.rows"),
        "takes",
    )


def source_cuts(docs: DataFrame, **options) -> DataFrame:
    """source, epochs, and cut: the first key, doc_id and size in this order of which the
    last epoch does not take all rows, with their number n and the words left for them.
    The table has one row per source; cut is null where all is taken."""
    cut = F.struct("key", "doc_id", "size", "n", "left")
    return write_table(
        placed_ties(docs, **options)
        .groupBy("source")
        .agg(F.max("epochs").alias("epochs"), F.min(F.when(F.col("size") * F.col("n") > F.col("left"), cut)).alias("cut")),
        "cuts",
    )


def mix_takes(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, source, size,
    source_size, target and taken, the words the mix takes of it.

    taken is a whole number of epochs plus, for documents before the cut in key
    order, one more; the document at the cut gives the words that are missing.
    So a source's takes add up to its target, rounded to a whole word. Null
    text counts 0 words and is taken 0 times; null sources are a source; ties
    and repeated rows each count as a row, in the order key, doc_id, size.
    """
    takes = tie_takes(docs, **options)
    columns = [F.col(c) for c in ("doc_id", "source", "size", "source_size", "target", "taken")]
    few = takes.where(F.col("rows") <= PORTION_ROWS)
    # many equal rows come back in tasks of their own
    many = (
        takes.where(F.col("rows") > PORTION_ROWS)
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(rows - 1) div {PORTION_ROWS}"))))
        .withColumn("rows", F.least(F.lit(PORTION_ROWS).cast("long"), F.col("rows") - F.col("part") * PORTION_ROWS))
        .repartition("doc_id", "source", "part")
        .drop("part")
    )
    each = few.unionByName(many)
    return each.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).select(*columns)


def mixed_documents(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as they are taken; the
    document at a source's cut ends after the last word that is taken.

    Rows that repeat a doc_id with the same source and size share evenly what
    is taken of them all, rounded up to whole words. Columns are those of ``docs``; n_chars, where there is
    one, follows the text. A row's own key tells on which side of its source's cut it
    is, so texts are not shuffled to meet their takes.
    """
    # the row as a struct: names of its columns meet none of the helpers'
    at = {c: F.col(f"d.row.c{i}") for i, c in enumerate(docs.columns)}
    sized = docs.select(row_struct(docs).alias("row"), word_count(F.col("text")).alias("size"))
    # structs are compared field by field, nulls first, as the sort has them
    own = F.struct(random_key(at["doc_id"], seed).alias("key"), at["doc_id"].alias("doc_id"), F.col("d.size").alias("size"))
    cut = F.struct(*(F.col(f"t.cut.{c}").alias(c) for c in ("key", "doc_id", "size")))
    whole = F.col("t.epochs") * F.col("d.size")
    take = (
        F.when(F.col("t.cut").isNull() | (own < cut), whole + F.col("d.size"))
        .when(own > cut, whole)
        .otherwise(whole + F.expr("(t.cut.left + t.cut.n - 1) div t.cut.n"))
    )
    copies = (
        sized.alias("d")
        .join(source_cuts(docs, seed=seed, **options).alias("t"), at["source"].eqNullSafe(F.col("t.source")))
        .select("d.row", "d.size", take.alias("take"))
        .where("take > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("take") / F.col("size")).cast("int"))))
        .alias("d")
    )
    words = F.col("take") - (F.col("copy") - 1) * F.col("size")
    cut = F.array_join(
        F.slice(F.split(F.btrim(at["text"], F.lit(BLANKS)), BLANK_CLASS + "+"), 1, F.least(words, F.col("size")).cast("int")),
        " ",
    )
    changed = {"text": F.when(words >= F.col("size"), at["text"]).otherwise(cut)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(changed["text"]).cast("long")
    return copies.select(*(changed.get(c, at[c]).alias(c) for c in docs.columns))
