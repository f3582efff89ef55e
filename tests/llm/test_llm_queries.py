"""The query functions of this package on a table with odd rows, against plain computations."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpuslake.llm import audio_features as audio
from corpuslake.llm import chunk_fingerprint, crf, queries, secret_scan, toxicity
from test_media_models import brute_base
from test_text_operators import brute_components, brute_fingerprint


@pytest.fixture(scope="module")
def odd(spark, sf_dir, tmp_path_factory):
    """A folder with documents and labels: those of the smallest size, and odd rows.  Ids are unique."""
    folder = str(tmp_path_factory.mktemp("odd"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(41)
    long = " ".join(rng.choice(["the", "word", "é", "stands", "12"]) for _ in range(60_000))
    rows = [(10_001, None), (10_002, ""), (10_003, "same text"), (10_004, "same text"), (10_005, long), (10_006, "\n\n \t"), (10_007, "a😀" * 70), (10_008, "password: abc def0123456789abcdef01234567")]
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.select(more.columns).unionByName(more.select([F.col(f.name).cast(docs.schema[f.name].dataType) for f in more.schema])).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def texts(spark, odd):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text").collect()}


def rows_of(name, spark, odd, texts, types):
    out = queries.QUERIES[name](spark, odd)
    assert dict(out.dtypes) == types
    found = out.collect()
    assert len(found) == len(texts)
    return {r.doc_id: r for r in found}


# op1


def brute_chunks(data):
    """Chunk ends by the rule, a byte at a time."""
    h, marks = 0, []
    for x in data:
        h = ((h << 1) + int(chunk_fingerprint.GEAR[x])) % 65536
        marks.append(h)
    ends, start = [], 0
    while start < len(data):
        end = start + chunk_fingerprint.MOST
        for e in range(start + chunk_fingerprint.LEAST, min(end, len(data)) + 1):
            zeros = 5 if e <= start + chunk_fingerprint.USUAL else 3
            if marks[e - 1] < 1 << 16 - zeros:
                end = e
                break
        start = min(end, len(data))
        ends.append(start)
    return ends


def brute_share(a, b):
    """Share of the bytes of ``a`` in chunks of ``b``, by the chunks' own bytes."""

    def chunks(text):
        out, start, data = {}, 0, text.encode()
        for e in brute_chunks(data):
            out[data[start:e]] = out.get(data[start:e], 0) + e - start
            start = e
        return out

    x, y = chunks(a), chunks(b)
    return sum(min(n, y.get(c, 0)) for c, n in x.items()) / sum(x.values()) if x else float(not y)


def test_op1(spark, odd, texts):
    kinds = {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}
    out = rows_of("op1_chunk_fingerprint", spark, odd, texts, kinds)
    order = sorted(texts)
    for i, after in zip(order, order[1:] + order[:1]):
        text = texts[i]
        n = len(text) // 4
        edited = text[: len(text) - n] + texts[after][:n]
        assert (out[i].n_chars, out[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        if len(text) + len(texts[after]) < 30_000:
            assert math.isclose(out[i].near_edited, brute_share(text, edited)) and math.isclose(out[i].near_next, brute_share(text, texts[after]))
    assert out[10_003].fingerprint == out[10_004].fingerprint and out[10_001].fingerprint == out[10_002].fingerprint == ""


def test_boundaries_by_rule():
    rng = random.Random(43)
    for n in (0, 1, 7, 8, 9, 500, 3000):
        data = bytes(rng.choice(b"abcdefgh \n") for _ in range(n))
        assert chunk_fingerprint.boundaries(data) == brute_chunks(data)
    assert chunk_fingerprint.boundaries(b"\0" * 400) == brute_chunks(b"\0" * 400)


def test_ranges_of_like_size(spark):
    rows = [(i, "x" * (20_000 if i < 40 else 10)) for i in range(2000)]
    base = spark.createDataFrame([(i, len(t)) for i, t in rows], "_cl_id long, size long")
    cuts, nulls = chunk_fingerprint._cuts(base, 16)
    assert cuts[0] == 0 and not nulls and 8 <= len(cuts) <= 16
    sizes = [sum(len(t) for i, t in rows if a <= i and (b is None or i < b)) for a, b in zip(cuts, cuts[1:] + [None])]
    assert max(sizes) <= 4 * sum(sizes) / len(sizes)


# op2


def brute_resampled(x):
    """6 kHz from 8 kHz: each output is a sum over the inputs around its time, weighted by a windowed sinc."""
    out = []
    for k in range(0, len(x), audio.DOWN):
        for p in range(audio.UP):
            time = k + p * audio.DOWN / audio.UP
            near = range(k - audio.TAPS // 2 + 1, k + audio.TAPS // 2 + 1)
            weights = []
            for i in near:
                t = i - time
                cut = audio.UP / audio.DOWN
                sinc = 1.0 if t == 0 else math.sin(math.pi * cut * t) / (math.pi * cut * t)
                weights.append(cut * sinc * math.cos(math.pi * max(-0.5, min(0.5, t / audio.TAPS))) ** 2)
            out.append(sum(w * (x[i] if 0 <= i < len(x) else 0.0) for w, i in zip(weights, near)) / sum(weights))
    return out


def brute_log_mel(x):
    """Frames of naive Fourier sums through triangles on the mel scale."""
    n = max(1, math.ceil((len(x) - audio.FRAME) / audio.HOP) + 1)
    top = 2595 * math.log10(1 + audio.NEW_RATE / 2 / 700)
    low = 2595 * math.log10(1 + 40.0 / 700)
    edges = [700 * (10 ** ((low + (top - low) * i / (audio.MELS + 1)) / 2595) - 1) for i in range(audio.MELS + 2)]
    out = []
    for f in range(n):
        frame = [x[i] if i < len(x) else 0.0 for i in range(f * audio.HOP, f * audio.HOP + audio.FRAME)]
        frame = [v * (0.5 - 0.5 * math.cos(2 * math.pi * i / audio.FRAME)) for i, v in enumerate(frame)]
        power = [abs(sum(v * complex(math.cos(a := -2 * math.pi * b * i / audio.FRAME), math.sin(a)) for i, v in enumerate(frame))) ** 2 for b in range(audio.FRAME // 2 + 1)]
        row = []
        for m in range(audio.MELS):
            total = 0.0
            for b, e in enumerate(power):
                hz = b * audio.NEW_RATE / audio.FRAME
                total += e * max(0.0, min((hz - edges[m]) / (edges[m + 1] - edges[m]), (edges[m + 2] - hz) / (edges[m + 2] - edges[m + 1])))
            row.append(math.log(total + 1e-6))
        out.append(row)
    return out


def brute_segments(mel):
    """A machine with two states."""
    level = [sum(row) / len(row) for row in mel]
    mean = sum(level) / len(level)
    spread = math.sqrt(sum((v - mean) ** 2 for v in level) / len(level))
    if spread < 1e-9:
        return []
    spans, start = [], None
    for i, v in enumerate(level):
        z = (v - mean) / spread
        if start is None and z >= audio.OPEN:
            start = i
        elif start is not None and z < audio.CLOSE:
            spans.append((start, i))
            start = None
    return spans + ([(start, len(level))] if start is not None else [])


def test_audio_by_definition():
    rng = random.Random(47)
    x = [rng.uniform(-1, 1) * (2.0 if 300 < i < 700 else 0.1) for i in range(1101)]
    y = audio.resample(np.array(x, np.float32))
    assert np.allclose(y, brute_resampled(x), atol=1e-5)
    mel = audio.log_mel(y)
    assert np.allclose(mel, brute_log_mel(y.tolist()), atol=2e-3)
    walk = np.array([[math.sin(i / 9) + rng.gauss(0, 0.8)] * audio.MELS for i in range(400)])
    for m in (mel, walk, np.zeros((5, audio.MELS)), walk[:1]):
        assert audio.segments(m) == brute_segments(m.tolist())
    assert len(audio.segments(walk)) > 1


def test_describe_by_definition():
    rng = random.Random(53)
    mel = np.array([[rng.gauss(0, 3) for _ in range(audio.MELS)] for _ in range(37)])
    head, means, spread = (list(map(int, part.split(","))) for part in audio.describe(mel, [(2, 5), (9, 20)]).split(":"))
    assert head == [37, 2, 14]
    for band in range(audio.MELS):
        v = [row[band] for row in mel.tolist()]
        m = sum(v) / len(v)
        assert abs(means[band] - 100 * m) <= 0.5001 and abs(spread[band] - 100 * math.sqrt(sum((a - m) ** 2 for a in v) / len(v))) <= 0.5001


def test_op2(spark, odd, texts):
    kinds = {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}
    out = rows_of("op2_audio_features", spark, odd, texts, kinds)
    for i, text in texts.items():
        data = text.encode()
        payload = data + b" " * ((-len(data)) % 192 if data else 192)
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(payload) + 44, hashlib.sha256(audio.wav(payload)).hexdigest())
    assert out[10_003][2:] == out[10_004][2:] and out[10_001][1:] == out[10_002][1:]


# op5, op6


def test_op5(spark, odd, texts):
    out = rows_of("op5_simhash", spark, odd, texts, {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})
    marks = {i: brute_fingerprint(t, 3) for i, t in texts.items()}
    roots = brute_components(sorted(marks), lambda a, b: (marks[a] ^ marks[b]).bit_count() <= 3)
    assert {i: (r.fingerprint, r.component_id) for i, r in out.items()} == {i: (f"{marks[i]:016x}", roots[i]) for i in texts}


def test_op6(spark, odd, texts):
    paths = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(paths.path(queries.TOKENIZER))
    ref.no_truncation()
    ref.no_padding()
    out = rows_of("op6_bpe", spark, odd, texts, {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})
    for i, text in texts.items():
        ids = ref.encode(text, add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(ref.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (out[i].n_tokens, out[i].ids_sha256, out[i].decoded_sha256) == want


# op8


def test_op8(spark, odd, texts):
    out = rows_of("op8_secret_scan", spark, odd, texts, {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"})
    for i, text in texts.items():
        base = [f"{k}:{a}:{b}" for k, a, b in brute_base(text)]
        r = out[i]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]
        every = r.spans.split(",") if r.spans else []
        assert [s for s in every if not s.startswith("crf")] == base


@pytest.fixture(scope="module")
def secrets(spark, sf_dir):
    return secret_scan.trained(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_secret_emission_and_decoding(secrets, texts):
    """Emissions from the features by name, and Viterbi over whole sequences."""
    rng = random.Random(59)
    some = [t[:3000] for t in texts.values()][:80] + [" ".join("".join(secret_scan.made_up(rng)) for _ in range(4)) for _ in range(40)] + ["", "x"]
    types = secret_scan.Types(secrets)
    ids = [types.of(t) for t in some]
    lengths = np.array(list(map(len, ids)))
    classes = np.array([secret_scan.file_class(t) for t in some])
    flat = np.concatenate(ids)
    got = secret_scan.emission(types, flat, lengths, classes)
    size = len(secrets.features)
    want = []
    for t, kind in zip(some, classes):
        tokens = secret_scan.TOKEN.findall(t)
        hint = [any(h in w.lower() for h in secret_scan.HINTS) for w in tokens]
        for i, w in enumerate(tokens):
            named = [j for j in range(max(0, i - 4), i) if hint[j] and tokens[j] not in ":="]
            assigned = any(tokens[k] in ":=" for j in named for k in range(j + 1, i))
            place = 2 if assigned else 1 if any(j >= i - 2 for j in named) else 0
            row = secrets.weights[6 * size + kind].copy()
            for part, at in ((place, i), (3, i - 1), (4, i - 2), (5, i + 1)):
                if 0 <= at < len(tokens):
                    for k in secret_scan.shape_keys(tokens[at], secrets.pairs):
                        row += secrets.weights[part * size + secrets.features.get(k, 0)]
            want.append(row)
    assert np.allclose(got, want)
    full = crf.viterbi(got, secrets.trans, secrets.begin, crf.Steps(lengths))
    assert full.any() and np.array_equal(secret_scan.tag_flat(types, flat, lengths, classes), full)


def test_secrets_among_look_alikes(secrets, spark, sf_dir):
    """Made-up secrets that no base pattern finds, each beside a look-alike, with another seed than the fit's."""
    rng = random.Random(61)
    docs = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text not rlike '[0-9]'").select("text").collect()]
    found = hit = wrong = there = 0
    while there < 400:
        words = rng.choice(docs).split()[:50]
        lead, secret, tail = secret_scan.made_up(rng)
        text = " ".join([*words[:20], lead]) + secret + tail + " " + " ".join([*words[20:30], secret_scan.look_alike(rng, [w for w in words if w.isalpha()]), *words[30:]])
        at = text.index(secret)
        base = secret_scan.base_spans(text)
        if any(a < at + len(secret) and at < b for a, b, _ in base):
            continue
        there += 1
        spans = [p for s in secret_scan.tag_texts(secret_scan.Types(secrets), [text])[0] for p in secret_scan.outside(text, s, base)]
        good = [s for s in spans if s[0] < at + len(secret) and at < s[1]]
        hit += bool(good)
        found += len(spans)
        wrong += len(spans) - len(good)
    assert hit / there >= 0.9 and wrong <= 0.1 * found, (hit, there, wrong, found)


# op9


def test_op9(spark, odd, texts):
    out = rows_of("op9_toxicity", spark, odd, texts, {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    for i, r in out.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    assert out[10_003].score == out[10_004].score and out[10_001].score == out[10_002].score


def test_toxic_scores_by_definition():
    rng = random.Random(67)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(200)]
    clean = [" ".join(rng.choice(plain) for _ in range(20)) for _ in range(40)]
    bad = [f"{t} vilxen {rng.choice(plain)} grubba {t}" for t in clean]
    model = toxicity.fit(clean + bad, [0] * 40 + [1] * 40)
    texts = ["", "sun", "vilxen sun moon", "Grubbast! moon_star vilxy"]
    types = toxicity.Types(model)
    marginal, lengths = toxicity.marginals(model, types, texts)
    n, at = len(model.weights) // 3, 0
    scores, _ = toxicity.score_texts(types, texts)
    for text, score in zip(texts, scores):
        words = toxicity.WORD.findall(text.lower())
        emit = np.zeros((len(words), 2))
        feature = lambda k: model.features.get(k, 0) if k else 0
        for i, w in enumerate(words):
            emit[i] = sum((model.weights[feature(k)] for k in toxicity.keys_of(w)), np.zeros(2))
            for j, part in ((i - 1, 1), (i + 1, 2)):
                if 0 <= j < len(words):
                    emit[i] += sum((model.weights[part * n + feature(k)] for k in toxicity.keys_of(words[j])[:2]), np.zeros(2))
        log_odds, expected = -12.0, 0.0
        if words:
            own, _, _ = crf.forward_backward(emit, model.trans, model.begin, crf.Steps(np.array([len(words)])))
            assert np.allclose(marginal[at : at + len(words)], own)
            none = math.prod(1 - min(max(p, 1e-9), 1 - 1e-9) for p in own[:, 1])
            log_odds, expected = min(max(math.log(max(1 - none, 1e-6)) - math.log(none), -12.0), 12.0), own[:, 1].sum()
        x = model.scorer[0] + model.scorer[1] * log_odds + model.scorer[2] * math.log1p(expected)
        assert abs(score - 1 / (1 + math.exp(-x))) < 1e-3
        at += len(words)
    assert list(lengths) == [0, 1, 3, 4] and scores[2] > scores[1]


def test_training_rows_are_bounded_and_stable(spark):
    rows = [(i % 50, f"text {i % 60}") for i in range(300)] + [(None, "x"), (3, "y" * 1000), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("mine"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] * 2 + [(7, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    rows_of_ = lambda frame: sorted(map(tuple, frame.collect()))
    some = toxicity.training_table(docs, labels, max_docs=10, max_chars=100)
    found = rows_of_(some)
    assert found == rows_of_(toxicity.training_table(docs.orderBy(F.desc("text")), labels, max_docs=10, max_chars=100))
    toxic = sum(r[3] for r in found)
    assert toxic <= 10 and len(found) - toxic <= 10 and len(found) > 10 and "y" * 1000 not in {r[4] for r in found}
    assert np.array_equal(toxicity.trained(docs, labels, max_docs=10).scorer, toxicity.fit_rows([r.asDict() for r in toxicity.training_table(docs, labels, max_docs=10).collect()]).scorer)
    texts = rows_of_(secret_scan.training_table(docs, max_docs=5, max_chars=100))
    assert len(texts) == 5 and texts == rows_of_(secret_scan.training_table(docs.orderBy("text"), max_docs=5, max_chars=100))


def test_hash_of_shingles():
    assert brute_fingerprint("One two  three", 3) == xxhash.xxh64_intdigest(b"one two three", 42)
