"""Line dedup, mixing, SimHash, fingerprints and BPE against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from corpuslake.llm import bpe, chunk_fingerprint, mixing, queries
from corpuslake.llm import line_dedup as line_dedup_module
from corpuslake.llm.graph import components
from corpuslake.llm.line_dedup import line_dedup
from corpuslake.llm.mixing import mix, mix_plan
from corpuslake.llm import simhash
from corpuslake.llm.simhash import hamming_links, near_dedup, simhash_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_agrees_with_sql(name, spark, sf_dir, agree):
    agree(queries.QUERIES[name](spark, sf_dir), queries.SQL[name])


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def odd_docs(spark):
    """Nulls everywhere, empty and repeated rows, ties, and a column named like private ones."""
    rows = [(1, None, "a"), (2, "", None), (None, "some words here", "a"), (3, "x " * 50_000, "b"), (4, "same text", "a"), (4, "same text", "a"), (5, "same text", "c"), (None, None, None)]
    return docs_of(spark, rows).withColumn("_cl_pos", F.lit(1)).withColumn("n_lines", F.lit("mine")).withColumn("size", F.lit(0))


# line dedup


def brute_lines(rows, min_chars, min_docs):
    ws = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(ws))
    where = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            where.setdefault(key(line), set()).add(i)
    hot = {k: max(v) for k, v in where.items() if len(k) >= min_chars and len(v) >= min_docs}
    return {i: "\n".join(x for x in (t or "").split("\n") if hot.get(key(x), i) == i) for i, t in rows}


def test_line_dedup(spark):
    rng = random.Random(1)
    pool = ["a" * 12, "B" * 12, "short", "", "Ünïcödé line of some length", "  padded line here  ", "\tPADDED LINE HERE"]
    rows = [(i, "\n".join(rng.choice(pool + [f"own {i} {rng.random()}"]) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup(df, min_chars=10, min_docs=5).collect()}
    assert got == brute_lines(rows, 10, 5)


def test_line_dedup_odd_rows(spark):
    out = line_dedup(odd_docs(spark), min_chars=3, min_docs=2)
    assert out.columns.count("n_lines") == 1 and "_cl_pos" in out.columns
    rows = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert (5, "same text") in rows and rows.count((4, "")) == 2 and len(rows) == 8
    assert line_dedup(odd_docs(spark).limit(0)).count() == 0


# mixing


def test_mix_targets(spark):
    rows = [(i, "w " * (i % 9 + 1), s) for s, n in (("a", 50), ("b", 400), (None, 30), ("c", 10)) for i in range(n)]
    rows = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    plan = mix_plan(docs_of(spark, rows)).collect()
    by_id = {r._cl_id: r for r in plan}
    sums, target = {}, {}
    for k, t, s in rows:
        r = by_id[k]
        assert 0 <= r._cl_copies <= 2 and r._cl_size == len(t.split())
        sums[s] = sums.get(s, 0) + r._cl_copies * r._cl_size
        target[s] = r._cl_target
    for s in sums:
        assert abs(sums[s] - target[s]) <= 9
    total = sum(r._cl_size for r in plan)
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6
    copies = mix(docs_of(spark, rows)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in copies} == {k: r._cl_copies for k, r in by_id.items() if r._cl_copies}


def test_mix_prefers_quality(spark):
    rows = [(i, "w " * 5, "big" if i < 900 else "other") for i in range(1000)]
    df = docs_of(spark, rows).withColumn("q", F.when(F.col("doc_id") % 2 == 0, 5.0).otherwise(0.5))
    got = mix_plan(df, share=0.5, weights=(1,), quality=F.col("q")).where("_cl_copies > 0 and _cl_id < 900").collect()  # the other source is taken whole
    even = sum(r._cl_id % 2 == 0 for r in got)
    assert even > 0.8 * len(got)


def test_mix_odd_rows(spark):
    df = odd_docs(spark)
    out = mix(df)
    assert out.columns == df.columns
    assert mix(df.limit(0)).count() == 0 and mix_plan(df.limit(0)).count() == 0
    assert {r.doc_id for r in out.collect()} <= {None, 3, 4, 5}
    assert sorted(map(str, out.collect())) == sorted(map(str, mix(df).collect()))


def test_mix_ranges_hold_few_rows(spark):
    """Whatever the weights, no key range holds much more of a source than the root of the table asks for."""
    import math

    n = 40_000
    for spread in (1.0, 1e-3, None):
        weight = F.lit(spread) if spread else F.pow(F.lit(10.0), -3.0 * (F.col("doc_id") % 100) / 100)
        df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), F.lit("one").alias("source"), weight.alias("q"))
        drawn = df.select((-F.log((F.conv(F.substring(F.md5(F.concat(F.lit("x"), F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52) / F.col("q")).alias("key"))
        parts = int(math.sqrt(n) / mixing.ROOT_SHARE)
        sizes = [r["count"] for r in drawn.groupBy(F.floor(F.log2("key") * parts)).count().collect()]
        assert sum(sizes) == n and max(sizes) <= 2 * n * math.log(2) / parts / math.e
    # sums don't depend on the cut
    got = {}
    share = mixing.ROOT_SHARE
    for mixing.ROOT_SHARE in (share, 10**9, 0.5):
        got[mixing.ROOT_SHARE] = sorted((r._cl_id, r._cl_copies) for r in mix_plan(df.limit(500).withColumn("text", F.repeat(F.lit("w "), (F.col("doc_id") % 7).cast("int"))), quality=F.col("q")).collect())
    mixing.ROOT_SHARE = share
    assert len(set(map(str, got.values()))) == 1


def test_line_dedup_with_heavy_lines(spark):
    """One line in a third of all documents, among others near the threshold; all of them, some or none are broadcast."""
    rng = random.Random(71)
    rows = [(i, "\n".join(["the very common line"] * (i % 3 == 0) + [f"a shared line {rng.randrange(60)}", f"own line number {i}", "The Very Common Line "])) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_lines(rows, 10, 5)
    heavy = line_dedup_module.HEAVY
    try:
        for line_dedup_module.HEAVY in (heavy, 10, 1):
            assert {r.doc_id: r.text for r in line_dedup(df, min_chars=10, min_docs=5).collect()} == want
    finally:
        line_dedup_module.HEAVY = heavy


# simhash


def brute_fingerprint(text, shingle):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = min(shingle, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {n: find(n) for n in nodes}


def test_simhash_components(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(5)
    rows += [(10_000 + k, t.replace(" ", "  ", 1).upper() if k % 2 else " ".join(t.split()[:-1])) for k, (_, t) in enumerate(rng.sample(rows, 60))]
    rows += [(20_000, ""), (20_001, None), (20_002, "one two"), (20_003, "ONE\ttwo")]
    marks = {i: brute_fingerprint(t, 3) for i, t in rows}
    want = brute_components(sorted(marks), lambda a, b: (marks[a] ^ marks[b]).bit_count() <= 3)
    got = simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r._cl_id: r._cl_fp & (2**64 - 1) for r in got} == marks
    assert {r._cl_id: r._cl_component for r in got} == want
    assert len(set(want.values())) < len(want)


def test_hamming_links(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(40)]
    marks = {b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (0, 1, 2, 3, 4)} | {0, 2**64 - 1, 2**63, 7}
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    want = {tuple(sorted((signed(a), signed(b)))) for a, b in itertools.combinations(marks, 2) if (a ^ b).bit_count() <= 3}
    got = hamming_links(spark.createDataFrame([(signed(m),) for m in marks], "fp long")).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_hamming_links_broadcast_nothing(spark):
    """The balls are far larger than the planner takes them for: those of 0.6 GB of documents broke the driver."""
    links = hamming_links(spark.range(1000).select(F.col("id").alias("fp")))
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_dedup(spark):
    rng = random.Random(11)
    words = [f"word{i}" for i in range(3000)]
    rows, groups = [], {}
    for g in range(40):
        text = [rng.choice(words) for _ in range(rng.randint(120, 400))]
        for copy in range(rng.choice([1, 1, 2, 5, 30])):
            changed = list(text)
            if copy:
                changed[rng.randrange(len(changed))] = "changed"
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(changed), "s"))
    kept = [r.doc_id for r in near_dedup(docs_of(spark, rows)).collect()]
    firsts = {}
    for i, g in groups.items():
        firsts.setdefault(g, i)
    assert sorted(kept) == sorted(firsts.values())


def test_near_dedup_keeps_what_differs(spark):
    rng = random.Random(13)
    words = [f"word{i}" for i in range(3000)]
    rows = []
    for g in range(30):
        text = [rng.choice(words) for _ in range(200)]
        # half of the text is new: a third of the shingles are shared
        rows += [(2 * g, " ".join(text), "s"), (2 * g + 1, " ".join(text[:100] + [rng.choice(words) for _ in range(100)]), "s")]
    assert near_dedup(docs_of(spark, rows)).count() == 60


def brute_near(rows, shingle=5, least=0.8):
    """Ids that stay: the least of each group that pairs of a similarity of ``least`` connect."""
    sets = {}
    for i, t, _ in rows:
        words = t.lower().split()
        n = min(shingle, len(words))
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()
    return sorted(set(brute_components(sorted(sets), lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])).values()))


def test_near_dedup_in_crowded_families(spark):
    rng = random.Random(29)
    words = [f"word{i}" for i in range(3000)]
    rows = []
    for family in range(3):
        template = [rng.choice(words) for _ in range(150)]
        bodies = [[rng.choice(words) for _ in range(rng.randint(8, 60))] for _ in range(60)]
        for k in range(240):
            # pages of a family are 0.5 to 0.9 alike; some are near copies of another one's body
            body = list(bodies[k % 60])
            for _ in range(rng.randint(0, 7)):
                body[rng.randrange(len(body))] = rng.choice(words)
            text = list(template)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text + body), "s"))
    rng.shuffle(rows)
    want = brute_near(rows)
    assert 3 < len(want) < len(rows)
    assert sorted(r.doc_id for r in near_dedup(docs_of(spark, rows)).collect()) == want


def test_near_dedup_keeps_texts_that_share_a_repeated_word(spark):
    rng = random.Random(31)
    words = [f"word{i}" for i in range(3000)]
    # over half of the shingles are one shingle, the others are each text's own
    rows = [(i, "um " * 200 + " ".join(rng.choice(words) for _ in range(100)), "s") for i in range(20)]
    # the same set of shingles, and one near it
    rows += [(20, "um " + rows[0][1], "s"), (21, rows[1][1] + " more", "s")]
    want = brute_near(rows)
    assert want == list(range(20))
    assert sorted(r.doc_id for r in near_dedup(docs_of(spark, rows)).collect()) == want


def test_parity_sketches_bound_differences():
    rng = np.random.default_rng(73)
    for n in (0, 1, 5, 42, 43, 300, 5000):
        a = rng.integers(-(2**63), 2**63, n)
        b = np.concatenate([a[n // 8 :], rng.integers(-(2**63), 2**63, n // 5 + 1)])
        x, y = simhash.parity_sketch(a), simhash.parity_sketch(b)
        assert len(x) * 64 >= 1.5 * n
        while len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        apart = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        assert apart <= len(set(a.tolist()) ^ set(b.tolist())) and (n < 300 or apart > 0.5 * len(set(a.tolist()) ^ set(b.tolist())))


def test_jaccard_of_digests():
    rng = random.Random(79)
    for _ in range(50):
        a, b = ({rng.randrange(2**64) for _ in range(rng.randint(0, 30))} for _ in range(2))
        b |= set(list(a)[: len(a) // 2])
        pack = lambda s: pa.scalar(simhash.digests(np.array(sorted(s) * 2, np.uint64)), pa.binary())
        assert simhash.jaccard(pack(a), pack(b)) == (len(a & b) / len(a | b) if a | b else 1.0)


def test_near_dedup_by_rounds(spark, monkeypatch):
    """However few comparisons leaders are given, and however many shingles go last, the groups are the same."""
    rng = random.Random(83)
    words = [f"word{i}" for i in range(2000)]
    template = [rng.choice(words) for _ in range(90)]
    rows = []
    for k in range(300):
        text = template + [rng.choice(words) for _ in range(rng.choice([10, 14, 18, 60]))] if k % 3 else [rng.choice(words) for _ in range(100)]
        rows.append((k, " ".join(text), "s"))
        if k % 5 == 0:
            rows.append((1000 + k, " ".join(text[:-1]), "s"))
    want = brute_near(rows)
    assert 3 < len(want) < len(rows)
    for per_node, crowd, rounds, sample in ((200, 32, 2, 8192), (0, 1, 3, 1), (0, 10**9, 1, 8192)):
        monkeypatch.setattr(simhash, "PER_NODE", per_node)
        monkeypatch.setattr(simhash, "CROWD", crowd)
        monkeypatch.setattr(simhash, "ROUNDS", rounds)
        monkeypatch.setattr(simhash, "SAMPLE", sample)
        assert sorted(r.doc_id for r in near_dedup(docs_of(spark, rows)).collect()) == want


def test_near_dedup_compares_few_texts_that_share_a_passage(spark, monkeypatch):
    """Pairs of texts that only share a passage grow with the texts, not with their square, however small the sample may be."""
    rng = random.Random(97)
    words = [f"word{i}" for i in range(5000)]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    rows = []
    for _ in range(6):
        passage = draw(60)
        rows += [(len(rows) + k, " ".join(passage + draw(90)), "s") for k in range(80)]
    rows += [(1000 + k, rows[k][1] + " more", "s") for k in range(0, 480, 16)]
    want = brute_near(rows)
    assert want == list(range(480))
    pairs = []
    monkeypatch.setattr(simhash, "SAMPLE", 16)
    monkeypatch.setattr(simhash, "crossing_pairs", lambda *args, real=simhash.crossing_pairs: pairs.append(real(*args)) or pairs[-1])
    assert sorted(r.doc_id for r in near_dedup(docs_of(spark, rows)).collect()) == want
    assert pairs[0].count() <= len(rows)


def test_levels_of_usual_shingles(spark):
    rng = np.random.default_rng(101)
    tokens = rng.integers(-(2**63), 2**63, 3000)
    times = [simhash.SAMPLE_TIMES * simhash.STEP**k for k in range(3)]
    counts = [(int(t), times[i // 500] + i % 2) for i, t in enumerate(tokens[:1500])]
    late = simhash.late_filter(spark.createDataFrame(counts, "token long, n long"))
    got = simhash.levels(tokens, late)
    assert (got[:1500] >= np.repeat([1, 2, 3], 500)).all() and (got[:1500] == np.repeat([1, 2, 3], 500)).mean() > 0.9
    assert (got[1500:] == 0).mean() > 0.9
    none = simhash.late_filter(spark.createDataFrame([], "token long, n long"))
    assert not simhash.levels(tokens, none).any() and not len(simhash.levels(tokens[:0], late))


def test_near_dedup_by_multi_index_hashing(spark, monkeypatch):
    """The index pairs each node that has another within three bits; near_dedup asks it before the exact join."""
    rng = random.Random(89)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    marks = [m ^ sum(1 << i for i in rng.sample(range(64), k)) for m in (rng.getrandbits(64) for _ in range(30)) for k in (0, 0, 1, 2, 5)]
    nodes = [(i, 10 + i % 3, signed(m)) for i, m in enumerate(marks)]
    got = simhash.index_pairs(spark.createDataFrame(nodes, "node long, size long, mark long")).collect()
    assert all((marks[r.a] ^ marks[r.b]).bit_count() <= 3 and (r.na, r.nb, r.most) == (10 + r.a % 3, 10 + r.b % 3, 10 + min(r.a % 3, r.b % 3)) for r in got)
    want = {i for i, m in enumerate(marks) if any(i != j and (m ^ n).bit_count() <= 3 for j, n in enumerate(marks))}
    assert {x for r in got for x in (r.a, r.b)} == want and len(got) <= 2 * len(nodes)
    found = []
    monkeypatch.setattr(simhash, "index_pairs", lambda info, real=simhash.index_pairs: found.append(real(info)) or found[-1])
    words = [f"word{i}" for i in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(12)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(100 + i, t + " more", "s") for i, t in enumerate(texts)]
    assert sorted(r.doc_id for r in near_dedup(docs_of(spark, rows)).collect()) == list(range(12)) == brute_near(rows)
    assert found[0].count() >= 6


def test_near_dedup_odd_rows(spark):
    df = odd_docs(spark)
    out = near_dedup(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 3, 4, None]
    assert near_dedup(df.limit(0)).count() == 0
    assert simhash_components(df).count() == 8 and simhash_components(df.limit(0)).count() == 0


# fingerprints


def test_boundaries_shift(spark):
    rng = random.Random(17)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    a, b = chunk_fingerprint.chunk_set(text), chunk_fingerprint.chunk_set("inserted words " + text)
    assert chunk_fingerprint.containment(a, b) > 0.95
    assert chunk_fingerprint.from_string(chunk_fingerprint.as_string(a)) == a
    assert sum(a.values()) == 5000


def test_gear_hash_in_blocks(monkeypatch):
    rng = random.Random(19)
    data = bytes(rng.randrange(256) for _ in range(4000))
    whole = chunk_fingerprint.boundaries(data)
    monkeypatch.setattr(chunk_fingerprint, "BLOCK", 97)
    assert chunk_fingerprint.boundaries(data) == whole and whole[-1] == 4000
    h = 0
    slow = []
    for x in data:
        h = ((h << 1) + int(chunk_fingerprint.GEAR[x])) & 0xFFFF
        slow.append(h)
    assert chunk_fingerprint.gear_hash(np.frombuffer(data, np.uint8)).tolist() == slow


def test_edit_fingerprints(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()] + [(-5, None), (10**15, "é" * 9)]
    out = {r.doc_id: r for r in chunk_fingerprint.edit_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    assert len(out) == len(rows)
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        own, changed = chunk_fingerprint.chunk_set(t), chunk_fingerprint.chunk_set(edited)
        r = out[i]
        assert (r.n_chars, r.edited_text, r.fingerprint) == (len(t), edited, chunk_fingerprint.as_string(own))
        assert r.near_edited == chunk_fingerprint.containment(own, changed)
        assert r.near_next == chunk_fingerprint.containment(own, chunk_fingerprint.chunk_set(after))


def test_edit_fingerprints_odd_rows(spark):
    out = chunk_fingerprint.edit_fingerprints(odd_docs(spark)).collect()
    assert len(out) == 8
    assert chunk_fingerprint.edit_fingerprints(odd_docs(spark).limit(0)).count() == 0
    one = chunk_fingerprint.edit_fingerprints(docs_of(spark, [(1, "abcdefgh", "s")])).first()
    assert one.edited_text == "abcdefab" and one.near_next == 1.0
    nulls = chunk_fingerprint.edit_fingerprints(docs_of(spark, [(None, "abcdefgh", "s"), (None, "12345678", "s")])).collect()
    assert sorted(r.edited_text for r in nulls) == ["123456ab", "abcdef12"]


# bpe


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    return P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


def tricky(rng, n):
    parts = ["a", "B", "'s", "é", "e\u0301", "ß", "İ", "Σ", " ", "\n", "\t", "  ", "1", "²", "!!", "=", "<|endoftext|>", "<|startof", "text|>", "\x1c", "\x85", "你好", "😀", "\r\n", "the ", "'ll", "_"]
    return "".join(rng.choice(parts) for _ in range(n))


@pytest.mark.parametrize("which", [0, 1])
def test_bpe_trees_are_exact(tokenizer, which):
    from tokenizers import Tokenizer

    with open(tokenizer[which], "rb") as f:
        c = bpe.Coder(f.read())
    ref = Tokenizer.from_file(tokenizer[which])
    ref.no_truncation()
    rng = random.Random(23)
    texts = [tricky(rng, rng.randint(0, 300)) for _ in range(60)] + ["=" * 1500, "ab" * 900, "x" * 100 + "é" * 300, ""]
    for text in texts:
        ids = ref.encode(text, add_special_tokens=False).ids
        want = np.array(ids, "<u4").tobytes()
        assert c.encode(text) == want
        assert c.decode(want) == ref.decode(ids, skip_special_tokens=False)
        for leaf in (37, 200):
            assert bpe.encode_tree(c, text, leaf) == want


def test_bpe_over_a_table(spark, sf_dir, tokenizer):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(tokenizer[0])
    ref.no_truncation()
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(60).unionByName(odd_docs(spark).select("doc_id", "text"))
    out = bpe.decode(bpe.encode(df, tokenizer[0], leaf_chars=500), tokenizer[0]).collect()
    got = sorted(hashlib.sha256(bytes(r.token_ids) + r.decoded.encode()).hexdigest() for r in out)
    want = []
    for r in df.collect():
        ids = ref.encode(r.text or "", add_special_tokens=False).ids
        want.append(hashlib.sha256(np.array(ids, "<u4").tobytes() + ref.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert got == sorted(want)
    both = bpe.encode(df, tokenizer[0], leaf_chars=500, with_decoded=True)
    assert sorted(map(str, both.select("doc_id", "decoded").collect())) == sorted(map(str, [type(r)(doc_id=r.doc_id, decoded=r.decoded) for r in out]))
    assert bpe.encode(df.limit(0), tokenizer[0]).count() == 0
