"""Document fingerprints by content-defined chunking.

A gear hash over the text's bytes sets chunk boundaries, normalised around a usual size: up
to it a boundary needs more zero bits, beyond it fewer.  A boundary depends on the 16 bytes
before it, so inserted or removed text moves the chunks around the edit and no others.  A
fingerprint is the set of chunk digests with their lengths; the length of the shared chunks
measures how much of a text is contained in another.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spool, text_of

LEAST, USUAL, MOST = 8, 32, 128
#: High bits of the 16-bit gear hash that must be zero: before the usual size, and after it.
STRICT, LOOSE = np.uint16(0xF800), np.uint16(0xE000)
#: Bytes of a range of documents, unless there are more than 10,000 ranges, and ranges weighed for each.
RANGE_BYTES, FINE = 64 << 20, 8
#: Bytes hashed at a time; bounds the memory for long texts.
BLOCK = 1 << 20


def _gear() -> np.ndarray:
    """A number for each byte: splitmix64 of it, cut to 16 bits."""
    x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(40)).astype(np.uint16)


GEAR = _gear()


def gear_hash(data: np.ndarray) -> np.ndarray:
    """After each byte, the sum of the last 16 bytes' gear numbers, each shifted by its distance (mod 2^16)."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        # windows of ``step`` bytes join to windows of twice as many
        h[step:] = h[step:] + (h[:-step] << np.uint16(step))
    return h


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks; the last one is the end of the data."""
    strict: list[np.ndarray] = []
    loose: list[np.ndarray] = []
    for at in range(0, len(data), BLOCK):
        before = min(at, 15)
        h = gear_hash(np.frombuffer(data, np.uint8, min(BLOCK, len(data) - at) + before, at - before))[before:]
        hits = np.flatnonzero((h & LOOSE) == 0)
        loose.append(hits + at + 1)
        strict.append(hits[(h[hits] & STRICT) == 0] + at + 1)
    ends, n = [], len(data)
    a = np.concatenate(strict).tolist() if strict else []
    b = np.concatenate(loose).tolist() if loose else []
    i = j = start = 0
    na, nb = len(a), len(b)
    while start < n:
        first, usual, last = start + LEAST, start + USUAL, start + MOST
        while i < na and a[i] < first:
            i += 1
        if i < na and a[i] <= usual:
            end = a[i]
        else:
            while j < nb and b[j] <= usual:
                j += 1
            end = b[j] if j < nb and b[j] <= last else last
        start = min(end, n)
        ends.append(start)
    return ends


def chunk_set(text: str) -> dict[int, int]:
    """Chunk digests (40 bits) and the bytes of all chunks that have them."""
    data = text.encode("utf-8", "surrogatepass")
    out: dict[int, int] = {}
    start, digest = 0, xxhash.xxh3_64_intdigest
    for end in boundaries(data):
        d = digest(data[start:end]) >> 24
        out[d] = out.get(d, 0) + end - start
        start = end
    return out


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of the bytes of ``a`` that lie in chunks of ``b``; of an empty text: 1 in an empty one, else 0."""
    total = sum(a.values())
    if not total:
        return 0.0 if b else 1.0
    return sum(min(n, b[d]) for d, n in a.items() if d in b) / total


def as_string(chunks: dict[int, int]) -> str:
    """The set as text: digests in order, five bytes each, and their lengths, four bytes each, in base64."""
    digests = sorted(chunks)
    both = np.empty((len(digests), 9), np.uint8)
    both[:, :5] = np.array(digests, ">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    both[:, 5:] = np.array([chunks[d] for d in digests], ">u4").view(np.uint8).reshape(-1, 4)
    return base64.b64encode(both.tobytes()).decode()


def from_string(fingerprint: str) -> dict[int, int]:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 9)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 3:] = raw[:, :5]
    return dict(zip(wide.view(">u8").ravel().tolist(), raw[:, 5:].copy().view(">u4").ravel().tolist()))


def fingerprint(docs: DataFrame, *, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of ``text_col`` to ``docs``.  Null and empty texts have an empty one; ``out_col`` is replaced."""
    small_batches(docs)
    kept = docs.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [as_string(chunk_set(t or "")) for t in batch.column(text_col).to_pylist()]
            yield batch.append_column(out_col, pa.array(marks, pa.string()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, `{out_col}` string")


def _cuts(sizes: DataFrame, n: int) -> tuple[list, bool]:
    """The least id, ids that cut the rows of ``sizes`` (_cl_id, size) into about ``n`` ranges of like size, and whether there are null ids.

    Quantiles of the ids make FINE times as many ranges; they are weighed, those of over a share
    are cut by quantiles of their own, and in the end neighbours are joined up to a share.
    The driver holds the ranges' edges and sizes, whose number is bounded by ``n``.
    """
    known = sizes.where(F.col("_cl_id").isNotNull())
    quantiles = [(i + 1) / (n * FINE) for i in range(n * FINE - 1)] or [0.5]
    least, found, nulls, total = sizes.agg(F.min("_cl_id"), F.percentile_approx("_cl_id", quantiles, 10_000), F.count_if(F.col("_cl_id").isNull()), F.sum("size")).first()
    if least is None:
        return [], bool(nulls)
    edges = np.array(sorted(set(found)), np.int64)
    for last in (False, False, False, True):

        @F.pandas_udf("int")
        def fine(ids, edges=edges):
            return type(ids)(np.searchsorted(edges, ids.to_numpy(), side="right"))

        ranged = known.withColumn("r", fine("_cl_id"))
        weights = np.zeros(len(edges) + 1)
        for row in ranged.groupBy("r").agg(F.sum("size").alias("s")).collect():
            weights[row["r"]] = row["s"]
        heavy = np.flatnonzero(weights > total / n).tolist()
        if last or not heavy:
            break
        parts = [(i + 1) / 16 for i in range(15)]
        more = ranged.where(F.col("r").isin(heavy)).groupBy("r").agg(F.percentile_approx("_cl_id", parts, 1000).alias("q")).collect()
        new = np.union1d(edges, np.array([i for row in more for i in row["q"] if i > least], np.int64))
        if len(new) == len(edges):
            break
        edges = new
    share = (np.cumsum(weights) - weights) * n // max(weights.sum(), 1)
    return [least, *edges[np.flatnonzero(np.diff(share) > 0)].tolist()], bool(nulls)


def with_next(docs: DataFrame, work, shape: str, *, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Run ``work`` (an iterator of (id, text, next text) -> rows) over the documents in ascending id; after the last comes the first.

    The documents are dealt once into ranges of ids that are of like size in bytes, a range a
    task.  The first document of each range is also dealt to the range before, as its
    look-ahead; no window over all rows is needed.
    Ids may be null (first in order) or repeated (then in the order of their texts).
    """
    small_batches(docs)
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("_cl_id"), text_of(text_col).alias("_cl_text"))
    sizes = spool(base.select("_cl_id", (F.octet_length("_cl_text") + 64).cast("long").alias("size")), "sizes")
    if partitions is None:
        total = sizes.agg(F.sum("size")).first()[0] or 0
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, total // RANGE_BYTES)
    cuts, has_null = _cuts(sizes, min(partitions, 10_000))
    has_null = has_null or not cuts
    # range r holds ids from cuts[r - 1] up to cuts[r]; nulls stand before the least id
    edges = np.array(cuts[0 if has_null else 1 :], np.int64)

    @F.pandas_udf("array<int>")
    def ranges_of(ids, nulls):
        """The range of an id, and the range before if the id opens its range."""
        import pandas as pd

        known, v = ~nulls.to_numpy(), ids.to_numpy()
        own = np.where(known, np.searchsorted(edges, v, side="right"), 0)
        opens = known & np.isin(v, edges)
        least = (known & (v == cuts[0])) if cuts and not has_null else ~known
        return pd.Series([[int(o), *([int(o) - 1 - FLAG] if p else []), *([len(edges) - FLAG] if q else [])] for o, p, q in zip(own, opens, least)])

    dealt = base.select("_cl_id", "_cl_text", F.explode(ranges_of(F.coalesce("_cl_id", F.lit(0)), F.col("_cl_id").isNull())).alias("_cl_r"))
    dealt = dealt.withColumn("_cl_ahead", F.col("_cl_r") < 0).withColumn("_cl_range", F.when(F.col("_cl_r") < 0, F.col("_cl_r") + FLAG).otherwise(F.col("_cl_r"))).drop("_cl_r")
    ordered = dealt.repartitionById(len(edges) + 1, F.col("_cl_range")).sortWithinPartitions("_cl_range", "_cl_ahead", F.col("_cl_id").asc_nulls_first(), "_cl_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def neighbours():
            held = None
            for batch in batches:
                for i, t, ahead, r in zip(*(batch.column(c).to_pylist() for c in ("_cl_id", "_cl_text", "_cl_ahead", "_cl_range"))):
                    if held is not None and held[2] == r:
                        yield held[0], held[1], t
                        held = None
                    if not ahead:
                        held = (i, t, r)

        yield from work(neighbours())

    return ordered.mapInArrow(run, shape)


#: Marks a look-ahead in ``ranges_of``: such numbers lie below zero.
FLAG = 1 << 30


def edited_text(text: str, after: str) -> str:
    """The last quarter of the code points replaced by the first as many of ``after``, or all of it."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def edit_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows_at_a_time: int = 256) -> DataFrame:
    """Fingerprints of each text and of its edited form, and what they share.

    (doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next);
    the likenesses are the share of the text's bytes whose chunks the other text contains.
    Null texts are empty; a single document is its own next; repeated ids follow each other in
    the order of their texts.  An empty table gives an empty result.
    """
    names = ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def work(rows):
        known: tuple[str, dict[int, int]] | None = None
        out: list[tuple] = []
        for i, text, after in rows:
            own = known[1] if known and known[0] == text else chunk_set(text)
            following = chunk_set(after)
            known = (after, following)
            edited = edited_text(text, after)
            changed = chunk_set(edited)
            out.append((i, len(text), edited, as_string(own), as_string(changed), containment(own, changed), containment(own, following)))
            if len(out) >= rows_at_a_time:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    shape = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, work, shape, id_col=id_col, text_col=text_col)
