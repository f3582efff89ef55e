"""URL filter: a blocked Bloom filter, then an exact hash join.

Listed entries are canonical URLs (host, path).  A URL stands for several candidates: its
host and each parent domain, with each prefix of its path that is as long as some listed
path.  The filter passes candidates that may be listed; a hash join with the list removes
the false positives.  The filter's size follows from the number of entries, up to MAX_BLOCKS;
what is broadcast never grows beyond that, a longer list only passes more candidates to the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, hide_private

#: The filter has blocks of 256 bits, eight 32-bit words, one bit set in each; 16 entries a block at most, up to 64 MB.
MIN_BLOCKS, MAX_BLOCKS, PER_BLOCK = 1 << 10, 1 << 21, 16
#: Lists up to this size are broadcast for the exact join, so that no entry's pages meet in one task.
BROADCAST_BYTES = 8 << 20
#: Odd multipliers of the eight words, by a rule: splitmix64's increment times 2k + 1.
SALTS = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) >> 16 & 0xFFFFFFFF | 1 for k in range(8)], np.uint32)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def blocks_for(entries: int) -> int:
    """Blocks of a filter of so many entries."""
    return min(MAX_BLOCKS, max(MIN_BLOCKS, 1 << (max(entries, 1) // PER_BLOCK).bit_length()))


def _bits(hashes: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash and its eight bits, a row of words a hash."""
    blocks = ((hashes >> np.uint64(32)) * np.uint64(n_blocks) >> np.uint64(32)).astype(np.int64)
    low = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return blocks, np.uint32(1) << ((low[:, None] * SALTS[None, :]) >> np.uint32(27))


def _hashes(keys: list[str] | np.ndarray) -> np.ndarray:
    """Numbers are hashes already."""
    if isinstance(keys, np.ndarray):
        return keys.view(np.uint64)
    return np.array([xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass")) for k in keys], np.uint64)


def in_filter(words: np.ndarray, keys: list[str] | np.ndarray) -> np.ndarray:
    """Which of the keys, texts or 64-bit hashes, the filter passes."""
    blocks, bits = _bits(_hashes(keys), len(words))
    return ((words[blocks] & bits) == bits).all(axis=1)


def build_filter(rules: DataFrame, entries: int | None = None) -> np.ndarray:
    """The filter of ``rules``' keys (string, or long: hashes), a row of eight words a block; ``entries`` is their number, if it is known.

    Each task builds a filter of its own, and the filters are joined by OR, block by block, in
    a shuffle; the driver gets the joined one, of MAX_BLOCKS rows at most.
    """
    size = blocks_for(rules.count() if entries is None else entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros((size, 8), np.uint32)
        for batch in batches:
            keys = batch.column("key")
            blocks, bits = _bits(_hashes(keys.to_numpy() if pa.types.is_int64(keys.type) else keys.to_pylist()), size)
            np.bitwise_or.at(words, blocks, bits)
        full = np.flatnonzero(words.any(axis=1))
        for at in range(0, len(full), 1 << 16):
            part = full[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(words[part].tolist(), pa.list_(pa.int64()))], ["block", "words"])

    parts = rules.select("key").mapInArrow(run, "block long, words array<long>")
    merged = parts.groupBy("block").agg(*[F.bit_or(F.col("words")[i]).alias(f"w{i}") for i in range(8)])
    words = np.zeros((size, 8), np.uint32)
    for row in merged.toLocalIterator():
        words[row["block"]] = row[1:]
    return words


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(action, host, path) as a table; hosts are lower-cased."""
    return spark.createDataFrame([(a, h, p) for a, h, p in rules], "action string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, *, default: str = "allow", url_col: str = "url") -> DataFrame:
    """Add host, path, rule and verdict to ``pages``.

    ``rules`` has action, host and path.  A rule fits its host and all subdomains if the path
    starts with the rule's path.  The longest rule (host plus path) wins; between equal
    lengths the longer host, then the action ``allow`` wins.  Without a rule the verdict is
    ``default``.  Null urls and those without ``://`` have an empty host and path, and fit no
    rule unless one has an empty host.  Repeated rules count once, repeated pages are judged
    each; empty tables give no rows or no hits.  Input columns named like an output are
    replaced.
    """
    spark = pages.sparkSession
    pages, names = hide_private(pages, url_col)
    listed = rules.select("action", ascii_lower(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path")).distinct()
    listed = listed.select("action", F.concat("host", F.lit("\n"), "path").alias("key"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"))
    # one row an entry, so a page meets an entry once; allow comes before block
    listed = listed.groupBy("key", "rule", "host_length").agg(F.min("action").alias("action"))
    # distinct lengths and depths are few, whatever the list's size: both are bounded by the longest entry
    lengths = [r[0] for r in rules.select(F.length(F.coalesce("path", F.lit(""))).alias("n")).distinct().collect()]
    depths = {r[0] for r in rules.select((F.size(F.split(F.coalesce("host", F.lit("")), r"\.")) - 1).alias("n")).distinct().collect()}
    size = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("key") + F.length("rule") + 32), F.lit(0)).alias("bytes"), F.coalesce(F.max(F.col("host_length") == 0), F.lit(False)).alias("bare")).first()
    bloom = spark.sparkContext.broadcast(build_filter(listed, size["n"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bloom.value
        for batch in batches:
            keys, at = [], []
            for i, (host, path) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())):
                ends = [path[:n] for n in lengths if n <= len(path)]
                labels = host.split(".")
                for depth in depths:
                    if depth < len(labels):
                        suffix = ".".join(labels[len(labels) - 1 - depth :])
                        keys += [f"{suffix}\n{end}" for end in ends]
                        at += [i] * len(ends)
            if not keys:
                continue
            hits = np.flatnonzero(in_filter(words, keys)).tolist()
            take = pa.array([at[k] for k in hits], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("host").take(take), batch.column("path").take(take), pa.array([keys[k] for k in hits], pa.string())], ["host", "path", "key"])

    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    placed = pages.select(*kept, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    # equal host and path get equal verdicts: each is looked up once
    looked = placed.select("host", "path").distinct()
    hits = looked.mapInArrow(run, "host string, path string, key string")
    best = F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), "host_length"))
    exact = F.broadcast(listed) if size["bytes"] <= BROADCAST_BYTES else listed
    place = F.concat("host", F.lit("\n"), "path")
    won = hits.join(exact, "key").groupBy("host", "path").agg(best.alias("_cl_won")).select(place.alias("_cl_place"), "_cl_won")
    # pages without a host can't be listed unless an entry has none either; each looks for something of its own
    own = place if size["bare"] else F.when(F.col("host") != "", place).otherwise(F.concat(F.lit("\n\n"), F.monotonically_increasing_id().cast("string")))
    out = placed.withColumn("_cl_own", own).join(won, F.col("_cl_own") == F.col("_cl_place"), "left")
    return out.select(*kept, "host", "path", F.col("_cl_won.rule").alias("rule"), F.coalesce("_cl_won.action", F.lit(default)).alias("verdict")).withColumnsRenamed(names)
