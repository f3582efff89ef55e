"""Line dedup in DataFrame functions only.

Lines are exploded, normalised and hashed; documents are counted per hash; lines of
hashes over the threshold are dropped except in the keeping document; the rest is put
together again by position.

Only hashes travel through the counting shuffles.  The text itself is shuffled once,
when the list of dropped positions comes back to its document.  Hashes that make up a
noticeable share of all lines, which can't be many, are broadcast, so that no task gets all
the places of one very common line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, ascii_lower, hide_private, spool, text_of


#: A hash is heavy from one in so many of all long lines on, so there are at most so many of them.
HEAVY = 10_000


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WS)))


def line_dedup(docs: DataFrame, *, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return ``docs`` with repeated lines dropped from ``text_col``.

    A key of at least ``min_chars`` code points that occurs in at least ``min_docs``
    documents loses its lines in all documents but the one with the largest id.
    Added: ``n_lines`` (before), ``n_dropped``; input columns of these names are replaced.

    Null text counts as one empty line and comes back as an empty text.  A null id is one
    more document, smaller than all others.  Rows that repeat an id belong to one
    document: they count once, and keep or lose a line together.  An empty table gives an
    empty result.
    """
    docs, names = hide_private(docs, id_col, text_col)
    ids = docs.select(F.col(id_col).alias("_cl_id"), text_of(text_col).alias("_cl_text")).withColumn("_cl_row", F.xxhash64("_cl_text"))
    lines = ids.select("_cl_id", "_cl_row", F.posexplode(F.split("_cl_text", "\n")).alias("_cl_pos", "_cl_line"))
    long_lines = lines.where(F.length("_cl_line") >= min_chars).withColumn("_cl_key", line_key(F.col("_cl_line"))).where(F.length("_cl_key") >= min_chars)
    hashed = spool(long_lines.select("_cl_id", "_cl_row", "_cl_pos", F.unhex(F.md5("_cl_key")).alias("_cl_hash")), "lines")

    per_doc = hashed.groupBy("_cl_hash", "_cl_id").agg(F.lit(1).alias("_cl_one"))
    common = per_doc.groupBy("_cl_hash").agg(F.count("*").alias("_cl_docs"), F.max("_cl_id").alias("_cl_keep")).where(F.col("_cl_docs") >= min_docs)
    common = spool(common, "common-lines")
    # documents with a heavy hash have one line of it at least, so HEAVY bounds their number too
    often = F.col("_cl_docs") * HEAVY > F.lit(hashed.count())
    heavy = F.broadcast(common.where(often).select("_cl_hash", "_cl_keep"))
    rest = common.where(~often).select("_cl_hash", "_cl_keep")
    marked = hashed.join(heavy, "_cl_hash").unionByName(hashed.join(heavy, "_cl_hash", "left_anti").join(rest, "_cl_hash"))
    drops = (
        marked.where(~F.col("_cl_id").eqNullSafe(F.col("_cl_keep")))
        .groupBy("_cl_id", "_cl_row")
        .agg(F.collect_set("_cl_pos").alias("_cl_drop"))
        .select(F.col("_cl_id").alias("_cl_drop_id"), F.col("_cl_row").alias("_cl_drop_row"), "_cl_drop")
    )

    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(*kept).withColumn("_cl_text", text_of(text_col)).withColumn("_cl_row", F.xxhash64("_cl_text"))
    joined = rows.join(drops, rows[id_col].eqNullSafe(F.col("_cl_drop_id")) & (F.col("_cl_row") == F.col("_cl_drop_row")), "left")
    # the generator holds the split lines as a column, so they aren't split again for each position
    split = joined.select("*", F.explode(F.array(F.split("_cl_text", "\n"))).alias("_cl_lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_cl_lines") - 1), F.col("_cl_drop"))
    text = F.when(F.col("_cl_drop").isNull(), F.col("_cl_text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("_cl_lines"), i)), "\n"))
    out = [text.alias(text_col) if c == text_col else F.col(c) for c in kept]
    done = split.select(*out, F.size("_cl_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_cl_drop"), F.lit(0)).cast("long").alias("n_dropped"))
    return done.withColumnsRenamed(names)
