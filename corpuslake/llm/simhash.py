"""SimHash near-dedup by multi-index hashing.

Fingerprints are cut into segments.  Around each segment a small Hamming ball is
enumerated, matches are fetched from the segment's table by an equi-join, and complete
distances are verified before a pair counts.

``hamming_links`` is exact: fingerprints of 64 bits in two halves, radius one, find every
pair of distinct fingerprints that differ in at most three bits.  Only distinct
fingerprints enter, so copies cost nothing, and a fingerprint has a bounded number of
neighbours (the ball of radius three), however many documents there are.

``near_dedup`` starts with the same: fingerprints of the distinct shingles, the index, and the
sets themselves to verify its pairs.  A similarity of 0.8 leaves about 15 % of the bits
different, which no bounded index finds for sure, so that an exact join follows for the links
that the index can't give: of prefixes of the ordered sets of shingles, which misses no pair.
Nodes first link to leaders of a shingle; after that all pairs of different groups that share
one are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hide_private, release, remove, small_batches, spool, spool_path, text_of
from .graph import components
from .url_filter import build_filter, in_filter

SEED = 42
#: Hashes whose bits are counted at a time; bounds the memory for long texts.
BLOCK = 1 << 15


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, as big-endian bytes; fewer words: of the whole sequence."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, ">u8")
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = min(shingle, len(words))
    first, last = (ends - sizes)[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist()
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[i:j], SEED) for i, j in zip(first, last)]), ">u8")


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Lane 0 is the hash itself; further lanes are splitmix64 of it."""
    h = h.astype(np.uint64)
    if lane:
        h = h + np.uint64((lane * 0x9E3779B97F4A7C15) & (2**64 - 1))
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return h.astype(">u8")


def fingerprint(text: str, shingle: int = 3, lanes: int = 1) -> list[int]:
    """``lanes`` signed 64-bit numbers; a bit is 1 if it is set in over half of the hashes.  No words: zeros."""
    return marks_of(shingle_hashes(text, shingle), lanes)


def marks_of(hashes: np.ndarray, lanes: int = 1) -> list[int]:
    """The fingerprint of hashes, as ``fingerprint`` has it."""
    out = []
    for lane in range(lanes):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(hashes), BLOCK):
            block = _mixed(hashes[i : i + BLOCK], lane)
            ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        bits = np.packbits(ones * 2 > max(len(hashes), 1))
        out.append(int(bits.view(">i8")[0]))
    return out


def fingerprints(docs: DataFrame, *, shingle: int, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_cl_id, _cl_row, _cl_fp0, _cl_fp1, ...) for each row; _cl_row is a hash of the text.  Null text: empty."""
    small_batches(docs)
    base = docs.select(F.col(id_col).alias("_cl_id"), F.xxhash64(text_of(text_col)).alias("_cl_row"), text_of(text_col).alias("_cl_text"))
    names = [f"_cl_fp{i}" for i in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(t, shingle, lanes) for t in batch.column("_cl_text").to_pylist()]
            columns = [pa.array([m[i] for m in marks], pa.int64()) for i in range(lanes)]
            yield pa.RecordBatch.from_arrays([batch.column("_cl_id"), batch.column("_cl_row"), *columns], ["_cl_id", "_cl_row", *names])

    kind = base.schema["_cl_id"].dataType.simpleString()
    return base.mapInArrow(run, f"_cl_id {kind}, _cl_row long, " + ", ".join(f"{n} long" for n in names))


def hamming_links(marks: DataFrame, fp: str = "fp") -> DataFrame:
    """(a, b): all pairs of the distinct 64-bit numbers in ``fp`` that differ in one to three bits, a pair once.

    Two halves: one of them differs in at most one bit.  A half of even parity enumerates its
    32 flips, one of odd parity only looks itself up, so each match is found once.

    The join is by sort and merge at any size: the planner doesn't see that the balls multiply
    the rows, and would send tens of times what it means to through the driver.
    """
    low = F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(F.col(fp), 32)
    halves = marks.select(F.col(fp).alias("v"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("n"), low.alias("h")), F.struct(F.lit(1).cast("long").alias("n"), high.alias("h")))).alias("s"))
    halves = halves.select("v", F.col("s.h").alias("h"), F.shiftleft(F.col("s.n"), 32).alias("at"))
    tables = halves.select((F.col("at") + F.col("h")).alias("k"), F.col("v").alias("b"))
    own = F.lit(0).cast("long")
    flips = F.array(own, *[F.lit(1 << i).cast("long") for i in range(32)])
    ball = F.when(F.bit_count("h") % 2 == 0, flips).otherwise(F.array(own))
    probes = halves.select("v", "h", "at", F.explode(ball).alias("x")).select((F.col("at") + F.col("h").bitwiseXOR(F.col("x"))).alias("k"), F.col("v").alias("a"), (F.col("x") != 0).alias("flip"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3
    found = probes.hint("merge").join(tables.hint("merge"), "k").where(near & (F.col("flip") | (F.col("a") < F.col("b"))))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def simhash_components(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_cl_id, _cl_fp, _cl_component) for each row of ``docs``.

    Rows whose fingerprints differ in at most three bits are linked; the component is named by
    the smallest id that can be reached.  Null and empty texts have fingerprint zero and link
    like any other.  Repeated rows are one node; a null id never names a component that has
    another id.  An empty table gives an empty result.
    """
    marked = spool(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col).select("_cl_id", F.col("_cl_fp0").alias("_cl_fp")), "simhash")
    nodes = marked.groupBy("_cl_fp").agg(F.min("_cl_id").alias("least"))
    roots = spool(components(hamming_links(nodes.select(F.col("_cl_fp").alias("fp")))), "roots")
    # neither table is broadcast: files of copies look far smaller than their rows
    rooted = nodes.join(roots.hint("merge"), nodes["_cl_fp"] == roots["node"], "left").select("_cl_fp", "least", F.coalesce("root", "_cl_fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("_cl_component"))
    by_mark = rooted.join(named, "root").select(F.col("_cl_fp").alias("fp"), "_cl_component")
    return marked.hint("merge").join(by_mark, marked["_cl_fp"] == by_mark["fp"]).select("_cl_id", "_cl_fp", "_cl_component")


#: Where prefixes meet in more than PER_NODE pairs a node, shingles of more than CROWD groups go last in the order.
PER_NODE, CROWD = 400, 32
#: Leaders that a node is compared with in a round before all pairs are, and such rounds at most, which only save work.
LEADERS, ROUNDS = 1, 2
#: One in SHARE texts is looked through for usual shingles, or more where that leaves fewer than SAMPLE, and so many of them must have one.
SHARE, SAMPLE, SAMPLE_TIMES = 4, 8192, 3
#: A usual shingle that STEP times as many texts have goes a level further back, of LEVELS.
STEP, LEVELS = 8, 8
#: Bytes of a shingle's hash that are compared in the end.
DIGEST = 6


def parity_sketch(own: np.ndarray) -> np.ndarray:
    """A bit tells whether an odd number of the hashes falls on it; there are a power of two of bits, 1.5 a hash at least.

    Sketches of two sets differ in at most as many bits as there are hashes in one set only.
    One of twice the bits is brought to the size of the other by joining its halves by XOR.
    """
    bits = max(64, 1 << math.ceil(math.log2(max(1, 1.5 * len(own)))))
    odd = np.bincount(own & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def levels(tokens: np.ndarray, late: np.ndarray) -> np.ndarray:
    """How far back each shingle goes: the number of its keys that the filter ``late`` of ``late_filter`` passes, one after another."""
    out = np.zeros(len(tokens), np.int8)
    for at in range(0, len(tokens), BLOCK):
        left = np.arange(at, min(at + BLOCK, len(tokens)))
        for lane in range(LEVELS):
            left = left[in_filter(late, _mixed(tokens[left].view(np.uint64), lane).astype(np.uint64))]
            if not len(left):
                break
            out[left] += 1
    return out


def late_filter(counts: DataFrame) -> np.ndarray:
    """A filter of the shingles in ``counts`` (token, n), with a key for each level that n reaches.

    What it passes by mistake goes further back too, in all texts alike, and so is still in one order.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, n = batch.column("token").to_numpy().view(np.uint64), batch.column("n").to_numpy()
            own = [_mixed(tokens[n >= SAMPLE_TIMES * STEP**lane], lane).astype(np.uint64) for lane in range(LEVELS)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], ["key"])

    return build_filter(spool(counts.mapInArrow(keys, "key long"), "near-late"))


def prefixes(docs: DataFrame, late: np.ndarray, *, shingle: int, least: float, id_col: str, text_col: str) -> DataFrame:
    """(_cl_id, _cl_row, node, size, mark, sketch, prefix) for each row; node is a hash of its set of shingles, size their number, mark its fingerprint.

    Shingles are ordered by their level in ``late``, then by hash.  The prefix is so long that
    two sets with a Jaccard similarity of ``least`` share a shingle of their prefixes.
    """
    small_batches(docs)
    base = docs.select(F.col(id_col).alias("_cl_id"), F.xxhash64(text_of(text_col)).alias("_cl_row"), text_of(text_col).alias("_cl_text"))
    shared = docs.sparkSession.sparkContext.broadcast(late)

    def one(text: str) -> tuple[int, int, int, np.ndarray, np.ndarray]:
        own = np.unique(shingle_hashes(text, shingle).astype(np.uint64).view(np.int64))
        n = len(own)
        sketch, mark = parity_sketch(own), marks_of(own)[0]
        node = int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))
        own = own[np.argsort(levels(own, shared.value), kind="stable")]
        return node, n, mark, sketch, own[: n - math.ceil(least * n - 1e-9) + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(t) for t in batch.column("_cl_text").to_pylist()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("_cl_id"), batch.column("_cl_row"), *columns], ["_cl_id", "_cl_row", "node", "size", "mark", "sketch", "prefix"])
        release()

    kind = base.schema["_cl_id"].dataType.simpleString()
    return base.mapInArrow(run, f"_cl_id {kind}, _cl_row long, node long, size long, mark long, sketch array<long>, prefix array<long>")


def usual_shingles(docs: DataFrame, *, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(token, n): shingles that SAMPLE_TIMES of a sample of texts have, and how many have each; copies in one task count once.

    They only go last in the order of ``prefixes``, which holds for any order: a better one saves
    comparisons.  The sample is a share of the texts, not a number of them.  So the texts that a
    shingle may stand in before it is usual don't become more as the table grows, and neither do
    those that a text meets by such shingles.
    """
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("row", F.xxhash64("text"))
    step = max(1, min(SHARE, docs.count() // SAMPLE))
    chosen = texts.where(F.pmod(F.xxhash64("id", "row"), F.lit(step)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            rows = batch.column("row").to_pylist()
            part = [i for i in range(len(rows)) if rows[i] not in done and not done.add(rows[i])]
            found = [np.unique(shingle_hashes(t, shingle).astype(np.uint64).view(np.int64)) for t in batch.column("text").take(pa.array(part, pa.int64())).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["token"])
        release()

    met = chosen.select("text", "row").mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n"))
    return spool(met.where(F.col("n") >= SAMPLE_TIMES), "near-usual")


def shared_tokens(marked: DataFrame) -> DataFrame:
    """(token, node, pos, n): the prefix shingles that several nodes have, with their places in the order, and how many have each."""
    nodes = marked.groupBy("node").agg(F.first("prefix").alias("prefix"))
    met = nodes.select("node", F.posexplode("prefix").alias("pos", "token"))
    return spool(met.select("token", "node", "pos", F.count("*").over(Window.partitionBy("token")).alias("n")).where("n > 1"), "near-shared")


def hub_scores(shared: DataFrame) -> DataFrame:
    """(node, score): how often a node's shingles stand in other nodes.

    Of many copies that were each changed elsewhere, what they were made from has the highest
    score, and may be the only one that all are similar to.
    """
    return spool(shared.groupBy("node").agg(F.sum(F.col("n") - 1).alias("score")), "near-scores")


def index_pairs(info: DataFrame) -> DataFrame:
    """(a, b, na, nb, most): pairs of nodes that multi-index hashing finds, those whose fingerprints differ in three bits at most.

    Nodes of one fingerprint meet its least node; of several fingerprints near to a fingerprint
    the least does, so that a family of near copies gives as many pairs as it has nodes.  What
    is left of it the exact join compares.
    """
    marks = spool(info.groupBy("mark").agg(F.min(F.struct("node", "size")).alias("first")), "near-marks")
    met = hamming_links(marks.select(F.col("mark").alias("fp"))).groupBy(F.col("b").alias("mark")).agg(F.min("a").alias("to"))
    first = lambda name, x: marks.select(F.col("mark").alias(name), F.col("first.node").alias(x), F.col("first.size").alias(f"n{x}"))
    near = met.join(first("mark", "a"), "mark").join(first("to", "b"), "to").select("a", "b", "na", "nb")
    equal = info.select("mark", F.col("node").alias("a"), F.col("size").alias("na")).join(first("mark", "b"), "mark").where("a <> b").select("a", "b", "na", "nb")
    return near.unionByName(equal).withColumn("most", F.least("na", "nb"))


def may_be_similar(pairs: DataFrame, info: DataFrame, least: float) -> DataFrame:
    """(a, b) of pairs (a, b, na, nb, most), less those whose sizes, shared prefixes or sketches rule out a similarity of ``least``.

    ``na`` and ``nb`` are the sets' sizes, ``most`` is what they have in common at most by their
    prefixes.  Sketches, which are longer than the rest of a row, only meet where these leave a pair open.
    """
    sketches = lambda x: info.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"))
    need = (F.col("na") + F.col("nb")) * (least / (1 + least)) - 1e-6
    fits = (F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-6) & (F.col("most") >= need)
    both = pairs.where(fits).drop("most").join(sketches("a"), "a").join(sketches("b"), "b")
    # sizes differ by a quarter at most, so one sketch is as long as the other or twice as long
    m = F.least(F.size("sa"), F.size("sb"))
    at = lambda s, i: F.coalesce(F.get(F.col(s), i), F.lit(0).cast("long"))
    bits = F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.bit_count(at("sa", i).bitwiseXOR(at("sb", i)).bitwiseXOR(at("sa", i + m)).bitwiseXOR(at("sb", i + m))))
    apart = F.aggregate(bits, F.lit(0), lambda x, y: x + y)
    return both.where((F.col("na") + F.col("nb") - apart) / 2 >= need).select("a", "b")


def leader_pairs(placed: DataFrame, least: float) -> DataFrame:
    """(a, b, na, nb, most): each node with those LEADERS of its shingles' leaders of other groups that it shares most with.

    A shingle's leaders are its node with the highest score, and those of its least and greatest
    groups.  Of two prefixes one ends first; beyond its end the sets share at most what its set has left.
    """
    ends = placed.select(F.col("node").alias("a"), F.col("size").alias("na"), "root", F.explode(F.array_distinct(F.array("hub", "lo", "hi"))).alias("x")).where("root <> x.root")
    met = ends.groupBy("a", "na", F.col("x.node").alias("b"), F.col("x.size").alias("nb")).agg(F.count("*").alias("common"))
    nth = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("common"), "b"))
    left = lambda n: F.ceil(F.col(n) * least - 1e-9) - 1
    return met.withColumn("nth", nth).where(F.col("nth") <= LEADERS).select("a", "b", "na", "nb", (F.col("common") + F.greatest(left("na"), left("nb"))).alias("most"))


def placed_tokens(shared: DataFrame, roots: DataFrame, sizes: DataFrame) -> DataFrame:
    """(token, node, pos, size, root, hub, lo, hi) of the shared shingles that stand in more than one group.

    ``sizes`` has node, size and score; a node without a root is a group.  Leaders are struct(root, node, size).
    """
    every = Window.partitionBy("token")
    own = shared.select("token", "node", "pos").join(sizes, "node")
    own = own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ends, best = F.struct("root", "node", "size"), F.struct("score", (-F.col("node")).alias("first"), "root", "node", "size")
    led = own.withColumn("lo", F.min(ends).over(every)).withColumn("hi", F.max(ends).over(every)).withColumn("best", F.max(best).over(every)).where("lo.root <> hi.root")
    return spool(led.select("token", "node", "pos", "size", "root", F.struct("best.root", "best.node", "best.size").alias("hub"), "lo", "hi"), "near-placed")


def crossing_pairs(placed: DataFrame, least: float) -> DataFrame:
    """(a, b, na, nb, most): all pairs of nodes of different groups that may be similar by their sizes and the places of shared shingles.

    Sets of known sizes that are similar have ``both`` shingles in common at least, so they share
    one of the first size - both + 1 of each: fewer than a prefix for any partner has.  What
    they share up to the last of these is counted; beyond it they share at most what one has left.
    """
    left = placed.select("token", F.col("node").alias("a"), F.col("size").alias("na"), F.col("root").alias("ra"), F.col("pos").alias("pa"))
    right = placed.select("token", F.col("node").alias("b"), F.col("size").alias("nb"), F.col("root").alias("rb"), F.col("pos").alias("pb"))
    both = F.ceil((F.col("na") + F.col("nb")) * (least / (1 + least)) - 1e-6)
    early = (F.col("pa") <= F.col("na") - both) & (F.col("pb") <= F.col("nb") - both)
    met = left.join(right, "token").where((F.col("ra") < F.col("rb")) & early)
    counted = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("common"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    return counted.select("a", "b", "na", "nb", (F.col("common") + F.least(F.col("na") - 1 - F.col("pa"), F.col("nb") - 1 - F.col("pb"))).alias("most"))


def similar(pairs: DataFrame, standing: DataFrame, texts: DataFrame, *, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have a Jaccard similarity of at least ``least``.

    ``standing`` has for each node the row, a hash of a text, that stands for it; ``texts`` has
    (row, text).  A Bloom filter picks the texts that are asked for, their sets are taken where
    they are, each once a task, and only sets are shuffled: once by row, and one set a pair.
    The join removes what the filter lets through.
    """
    bloom = texts.sparkSession.sparkContext.broadcast(build_filter(standing.select(F.col("row").cast("string").alias("key")), standing.count()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            rows = batch.column("row").to_pylist()
            asked = np.flatnonzero(in_filter(bloom.value, list(map(str, rows)))).tolist()
            for at in range(0, len(asked), 500):
                part = [i for i in asked[at : at + 500] if rows[i] not in done and not done.add(rows[i])]
                found = [digests(shingle_hashes(t, shingle)) for t in batch.column("text").take(pa.array(part, pa.int64())).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([rows[i] for i in part], pa.int64()), pa.array(found, pa.binary())], ["row", "own"])
        release()

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [jaccard(x, y) >= least for x, y in zip(batch.column("sa"), batch.column("sb"))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    own = texts.mapInArrow(sets, "row long, own binary").groupBy("row").agg(F.first("own").alias("own"))
    rows = lambda x: standing.select(F.col("node").alias(x), F.col("row").alias(f"r{x}"))
    placed = pairs.join(rows("a"), "a").join(rows("b"), "b")
    left = own.select(F.col("row").alias("ra"), F.col("own").alias("sa"))
    right = own.select(F.col("row").alias("rb"), F.col("own").alias("sb"))
    met = placed.join(left, "ra").join(right, "rb").select("a", "b", "sa", "sb")
    return met.mapInArrow(compared, "a long, b long")


def digests(hashes: np.ndarray) -> bytes:
    """The first DIGEST bytes of each distinct hash, in order."""
    own = np.unique(hashes.astype(np.uint64)).astype(">u8")
    return own.view(np.uint8).reshape(-1, 8)[:, :DIGEST].tobytes()


def jaccard(a: pa.BinaryScalar, b: pa.BinaryScalar) -> float:
    """The similarity of two sets of ``digests``; of empty ones 1."""

    def numbers(x: pa.BinaryScalar) -> np.ndarray:
        raw = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, DIGEST)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, 8 - DIGEST :] = raw
        return wide.view(">u8").ravel().astype(np.uint64)

    x, y = numbers(a), numbers(b)
    common = len(np.intersect1d(x, y))
    return common / (len(x) + len(y) - common) if len(x) + len(y) else 1.0


def near_dedup(docs: DataFrame, *, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep one document, that of the smallest id, of each group of near copies.

    Near: a Jaccard similarity of ``least`` or more on the sets of shingles; a group is what such
    pairs connect.  Exact: rows of one set are one node, and every other link is compared
    shingle by shingle, whether multi-index hashing or the join of prefixes behind it found it.  Null and empty texts are copies of each other.  Of rows that repeat id
    and text one stays.  A null id stays only where a group has no other id.  An empty table
    gives an empty result.  The columns of ``docs`` are returned.
    """
    docs, names = hide_private(docs, id_col, text_col)
    options = {"shingle": shingle, "least": least, "id_col": id_col, "text_col": text_col}
    spark = docs.sparkSession
    small_batches(docs)
    usual = usual_shingles(docs, shingle=shingle, id_col=id_col, text_col=text_col)
    path = spool_path(spark, "near")
    whole = spool(prefixes(docs, late_filter(usual), **options), "near", path=path)
    rows = docs.withColumn("_cl_row", F.xxhash64(text_of(text_col)))
    texts = docs.select(text_of(text_col).alias("text")).withColumn("row", F.xxhash64("text"))

    info = spool(whole.groupBy("node").agg(F.first("size").alias("size"), F.first("mark").alias("mark"), F.first("sketch").alias("sketch")), "near-nodes")
    marked = spool(whole.select("_cl_id", "_cl_row", "node"), "near-rows")
    shared = shared_tokens(whole)
    remove(spark, path)  # all that comes of it has been written

    def alike(pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
        pairs = may_be_similar(pairs, info, least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = spool(pairs if known is None else pairs.join(known, ["a", "b"], "left_anti"), "near-open")
        asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        standing = spool(marked.join(asked, "node", "left_semi").groupBy("node").agg(F.min("_cl_row").alias("row")), "near-standing")
        return spool(similar(pairs, standing, texts, shingle=shingle, least=least), "near-links")

    def crowded(placed: DataFrame) -> tuple[DataFrame, bool]:
        """Counts of each shingle, and whether all pairs that share one are too many."""
        groups = spool(placed.groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("root").alias("groups")), "near-groups")
        meetings = groups.agg(F.sum(F.col("n").cast("double") * F.col("groups"))).first()[0] or 0
        return groups, meetings > PER_NODE * info.count()

    def by_leaders(shared: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
        """Groups are joined through leaders, so that the pairs left to compare are few: (links, placed, groups, crowded)."""
        sizes = spool(info.select("node", "size").join(hub_scores(shared), "node"), "near-sizes")
        placed = placed_tokens(shared, components(links), sizes)
        for _ in range(ROUNDS):
            found = alike(leader_pairs(placed, least), links)
            links = links.unionByName(found)
            placed = placed_tokens(shared, components(links), sizes)
            groups, many = crowded(placed)
            if not many or not found.count():
                break
        return links, placed, groups, many

    links, placed, groups, many = by_leaders(shared, alike(index_pairs(info)))
    if many:
        found = groups.where(F.col("groups") > CROWD).select("token", F.greatest(F.col("groups"), F.lit(SAMPLE_TIMES).cast("long")).alias("n"))
        if not found.isEmpty():
            late = late_filter(usual.unionByName(found))
            links, placed, _, _ = by_leaders(shared_tokens(prefixes(docs, late, **options)), links)
    roots = components(links.unionByName(alike(crossing_pairs(placed, least))))
    group = F.coalesce(F.col("root"), F.col("node"))
    members = marked.join(roots, "node", "left").select("_cl_id", "_cl_row", group.alias("group"))
    # null ids last
    stays = members.groupBy("group").agg(F.min(F.struct(F.col("_cl_id").isNull(), F.col("_cl_id"), F.col("_cl_row"))).alias("s"))
    stays = stays.select(F.col("s._cl_id").alias("_cl_stay_id"), F.col("s._cl_row").alias("_cl_stay_row"))
    kept = rows.join(stays, rows[id_col].eqNullSafe(F.col("_cl_stay_id")) & (F.col("_cl_row") == F.col("_cl_stay_row")))
    repeat = F.row_number().over(Window.partitionBy(id_col, "_cl_row").orderBy("_cl_row"))
    return kept.withColumn("_cl_repeat", repeat).where("_cl_repeat = 1").select(*docs.columns).withColumnsRenamed(names)
