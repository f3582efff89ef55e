"""Mixing sources to target weights in DataFrame functions only.

Efraimidis-Spirakis sampling: each document draws an exponential key scaled by its
quality weight; within a source, documents are taken in the order of their keys until
their sizes fill the token budget.  Complete epochs come before the fractional selection.

The prefix sums within a source don't run in one task: keys fall into ranges of equal ratio,
sums are taken per (source, range), and only running sums within one range order single
documents.  A key is exponential with the rate of its own document's weight, so whatever the
weights, a range from k to k * (1 + r) is expected to hold r / e of a source's documents at
most; ranges and documents in a range both grow with the root of the table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, hide_private, spool, text_of

#: Ranges in each doubling of the key: the root of the number of rows over this, one at least.
ROOT_SHARE = 4
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text."""
    bare = F.btrim(text, F.lit(WS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, "[\\x20\\x09-\\x0D]+"))).cast("long")


def mean_word_quality(text: Column, size: Column) -> Column:
    """A weight in (0, 1]: 1 where words have seven characters with their space, less far from that."""
    return 1.0 / (1.0 + F.abs(F.length(text) / F.greatest(size, F.lit(1)) - 7.0))


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """Targets per source from columns (_cl_source, _cl_source_size): one row a source.

    Sources by code point, null last, take the weights in turn.  ``share`` of all sizes is
    split by weight; no source gets more than ``epochs`` times its size, the excess goes
    to the others.  This is water filling: sorted by cap / weight, a source is capped while
    its ratio lies under the level that the sources from it onward would share.
    """
    everything = Window.partitionBy(F.lit(1))
    rank = F.row_number().over(everything.orderBy(F.col("_cl_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    caps = sizes.select("*", weight.alias("_cl_weight"), (F.col("_cl_source_size") * float(epochs)).alias("_cl_cap")).withColumn("_cl_ratio", F.col("_cl_cap") / F.col("_cl_weight"))
    order = everything.orderBy("_cl_ratio", F.col("_cl_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("_cl_source_size").over(everything) * share
    levels = caps.select(
        "*",
        F.row_number().over(order).alias("_cl_k"),
        ((total - F.coalesce(F.sum("_cl_cap").over(before), F.lit(0.0))) / F.sum("_cl_weight").over(onward)).alias("_cl_level"),
    )
    level = F.min(F.when(F.col("_cl_ratio") >= F.col("_cl_level"), F.struct("_cl_k", "_cl_level"))).over(everything)["_cl_level"]
    return levels.select("_cl_source", "_cl_source_size", F.least(F.col("_cl_cap"), F.coalesce(F.col("_cl_weight") * level, F.col("_cl_cap"))).alias("_cl_target"))


def mix_plan(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, epochs: int = 2, seed: str = "mix", quality: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a document: _cl_id, _cl_row (hash of id and text), _cl_size, _cl_source_size, _cl_target, _cl_copies.

    Keys come from id and text alone, so reruns agree.  Rows that are equal in id and text
    get equal keys; which of them the budget ends at doesn't show.  A given quality is taken
    between 0.001 and a million, a null or NaN one as the least.  Null texts have size 0, null
    sources are one source, an empty table gives an empty plan.
    """
    text = text_of(text_col)
    drawn = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text)))
    base = docs.select(F.col(id_col).alias("_cl_id"), F.col(source_col).alias("_cl_source"), text.alias("_cl_text"), n_words(text).alias("_cl_size"), drawn.alias("_cl_row"), *([quality.cast("double").alias("_cl_given")] if quality is not None else []))
    uniform = (F.conv(F.substring("_cl_row", 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    given = F.when(F.isnan("_cl_given"), None).otherwise(F.col("_cl_given")) if quality is not None else None
    weight = F.least(F.greatest(F.coalesce(given, F.lit(1e-3)), F.lit(1e-3)), F.lit(1e6)) if quality is not None else mean_word_quality(F.col("_cl_text"), F.col("_cl_size"))
    keyed = spool(base.select("_cl_id", "_cl_source", "_cl_row", "_cl_size", (-F.log(uniform) / weight).alias("_cl_key")), "mix")
    # the cut of the ranges doesn't change the sums, only how many rows a range holds
    parts = max(1, int(math.sqrt(keyed.count()) / ROOT_SHARE))
    keyed = keyed.withColumn("_cl_bucket", F.floor(F.log2("_cl_key") * parts).cast("long"))

    # the histogram grows with the root of the table; all further sums read it
    buckets = spool(keyed.groupBy("_cl_source", "_cl_bucket").agg(F.sum("_cl_size").alias("_cl_sum")), "mix-buckets")
    targets = source_targets(buckets.groupBy("_cl_source").agg(F.sum("_cl_sum").alias("_cl_source_size")), weights=weights, share=share, epochs=epochs)
    before = Window.partitionBy("_cl_source").orderBy("_cl_bucket").rowsBetween(Window.unboundedPreceding, -1)
    prefix = buckets.select("_cl_source", "_cl_bucket", F.coalesce(F.sum("_cl_sum").over(before), F.lit(0)).alias("_cl_prefix"))
    edges = prefix.alias("p").join(targets.alias("t"), F.col("p._cl_source").eqNullSafe(F.col("t._cl_source"))).select(
        F.col("p._cl_source").alias("_cl_s"), F.col("_cl_bucket").alias("_cl_b"), "_cl_prefix", "_cl_source_size", "_cl_target")

    joined = keyed.join(edges, F.col("_cl_source").eqNullSafe(F.col("_cl_s")) & (F.col("_cl_bucket") == F.col("_cl_b")))
    inside = Window.partitionBy("_cl_source", "_cl_bucket").orderBy("_cl_key", "_cl_row").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_cl_prefix") + F.coalesce(F.sum("_cl_size").over(inside), F.lit(0))
    whole = F.when(F.col("_cl_source_size") > 0, F.floor(F.col("_cl_target") / F.col("_cl_source_size"))).otherwise(0)
    rest = F.col("_cl_target") - whole * F.col("_cl_source_size")
    more = F.when(start + F.col("_cl_size") / 2 <= rest, 1).otherwise(0)
    return joined.select("_cl_id", "_cl_row", "_cl_size", "_cl_source_size", "_cl_target", (whole + F.when(whole < epochs, more).otherwise(0)).cast("int").alias("_cl_copies"))


def mix(docs: DataFrame, *, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Return each document as many times as the mix takes it, with the columns of ``docs``.

    Documents without words take no budget and stay out.  Null sources are one source, the
    last in order; a null text has size 0.  An empty table gives an empty result.
    """
    docs, names = hide_private(docs, id_col, text_col)
    text = text_of(text_col)
    plan = mix_plan(docs, seed=seed, id_col=id_col, text_col=text_col, **options).where((F.col("_cl_copies") > 0) & (F.col("_cl_size") > 0))
    # equal rows have one key and one plan each; their copies are summed and dealt to one of them
    plan = plan.groupBy("_cl_row").agg(F.sum("_cl_copies").cast("int").alias("_cl_n"), F.count("*").alias("_cl_rows"))
    row = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text)))
    keyed = docs.withColumn("_cl_doc_row", row)
    # of _cl_rows equal rows that share _cl_n copies, each gets the same number, the first ones one more
    nth = F.row_number().over(Window.partitionBy("_cl_doc_row").orderBy("_cl_doc_row")) - 1
    taken = keyed.join(plan, F.col("_cl_doc_row") == F.col("_cl_row")).withColumn("_cl_nth", nth)
    copies = F.floor(F.col("_cl_n") / F.col("_cl_rows")) + F.when(F.col("_cl_nth") < F.col("_cl_n") % F.col("_cl_rows"), 1).otherwise(0)
    return taken.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("_cl_copy")).drop("_cl_copy").withColumnsRenamed(names)
