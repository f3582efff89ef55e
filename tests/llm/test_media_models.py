"""Audio, URL filter, WARC, secrets, toxicity and the pipeline."""

import hashlib
import importlib.util
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from corpuslake.llm import audio_features as audio
from corpuslake.llm import crf, secret_scan, toxicity, url_filter, warc
from corpuslake.llm.common import shared_dir


# audio


def test_payload_survives():
    for text in ("", "a", "x" * 192, "é" * 100):
        p = audio.payload_of(text)
        assert len(p) % 192 == 0 and p.rstrip(b" ") == text.encode().rstrip(b" ") and len(p) > 0
        assert audio.samples(audio.wav(p)) == p
    with pytest.raises(ValueError):
        audio.samples(b"RIFF")


def test_resampler_keeps_tones():
    t = np.arange(8000) / 8000
    y = audio.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32))
    assert len(y) == 6000
    spectrum = np.abs(np.fft.rfft(y))
    assert abs(np.argmax(spectrum) - 440) <= 1
    quiet = audio.resample(np.sin(2 * np.pi * 3600 * t).astype(np.float32))
    assert np.abs(quiet[100:-100]).max() < 0.4 < np.abs(y).max()


def test_mel_segments_and_tensors():
    x = np.zeros(60_000, np.float32)
    x[20_000:40_000] = np.sin(np.arange(20_000) * 0.3)
    mel = audio.log_mel(x)
    assert mel.shape == (468, audio.MELS)
    (a, b), = audio.segments(mel)
    assert abs(a * audio.HOP - 20_000) < 400 and abs(b * audio.HOP - 40_000) < 400
    back = audio.read_tensors(audio.tensors(mel))
    values = np.concatenate([np.asarray(v.as_py() if not hasattr(v, "to_numpy") else v.to_numpy()).reshape(-1, audio.MELS) for v in back["mel"].combine_chunks()])
    assert np.array_equal(values[: len(mel)], mel.astype(np.float16))
    assert back["start_s"][1].as_py() == 16 * audio.HOP / audio.NEW_RATE


def test_audio_over_a_table(spark):
    df = spark.createDataFrame([(1, "some text"), (2, "some text"), (3, None), (None, "x" * 5000)], "doc_id long, text string")
    out = audio.features(audio.to_media(df), with_tensors=True).collect()
    by = {r.doc_id: r for r in out}
    assert by[1].feature == by[2].feature and by[3].payload_bytes == 192 and by[None].payload_bytes == 5184
    p = audio.payload_of("some text")
    assert (by[1].payload_sha256, by[1].tail_crc32, by[1].media_bytes) == (hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), 236)
    assert audio.read_tensors(bytes(by[1].tensors)).num_rows == 1
    assert audio.features(audio.to_media(df.limit(0))).count() == 0


def test_op2_stores_tensors_and_spans(spark, tmp_path, monkeypatch):
    from corpuslake.llm import queries

    texts = ["", "some text " * 40, "".join(chr(32 + i * i % 90) for i in range(9000))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    written = {}
    spool = queries.spool
    monkeypatch.setattr(queries, "spool", lambda df, name, **kw: written.setdefault(name, spool(df, name, **kw)))
    got = {r.doc_id: r for r in queries.op2_audio_features(spark, str(tmp_path)).collect()}
    stored = {r.doc_id: r for r in written["features"].collect()}
    for i, text in enumerate(texts):
        mel = audio.log_mel(audio.resample((np.frombuffer(audio.payload_of(text), np.uint8).astype(np.float32) - 128) / 128))
        assert np.array_equal(audio.mel_of(bytes(stored[i].tensors)), mel.astype(np.float16))
        assert [round(s.start_s * audio.NEW_RATE / audio.HOP) for s in stored[i].segments] == [a for a, _ in audio.segments(mel)]
        assert got[i].feature == audio.describe(mel.astype(np.float16), audio.segments(mel))


# urls


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.split(r"[/?#]", rest)[0])
    path = re.split(r"[?#]", rest[len(re.split(r"[/?#]", rest)[0]) :])[0]
    fits = [(len(h + p), len(h), a == "allow", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_url_filter(spark):
    rng = random.Random(2)
    labels, ends = ["a", "b", "com", "net", "x-y", ""], ["/", "/en/", "/en/7", "/EN", ""]
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((".".join(rng.choice(labels[:5]) for _ in range(rng.randint(1, 3))), rng.choice(ends)) for _ in range(60))}.values())
    urls = [f"{rng.choice(['http://', 'HTTPS://', '', 'x://y://'])}{'.'.join(rng.choice(labels + ['COM']) for _ in range(rng.randint(1, 5)))}{rng.choice(ends)}{rng.choice(['', '7', '?q=/en/', '#/en/', 'x/y'])}" for _ in range(400)] + [None, "", "://", "a\nb://com/en/7"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("verdict", F.lit("mine"))
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, url_filter.rules_table(spark, rules)).collect()}
    assert out == {i: brute_verdict(u, rules) for i, u in enumerate(urls)}
    assert {r.verdict for r in url_filter.judge(df, url_filter.rules_table(spark, rules).limit(0), default="block").collect()} == {"block"}
    assert url_filter.judge(df.limit(0), url_filter.rules_table(spark, rules)).count() == 0


def test_filter_has_no_false_negatives(spark):
    keys = [f"host{i}\n/p" for i in range(5000)]
    words = url_filter.build_filter(spark.createDataFrame([(k,) for k in keys], "key string"))
    assert url_filter.in_filter(words, keys).all()
    assert url_filter.in_filter(words, [f"other{i}" for i in range(5000)]).mean() < 0.01


# warc


def test_warc_round_trip(spark, tmp_path):
    long = "<html>" + "é" * 200 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(3, "http://a/\r\nX: y", long), (1, None, long), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (1, None, long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("mine"))
    path = str(tmp_path / "archive")
    warc.write_archive(df, path)
    out = warc.read_archive(spark, path).collect()
    assert len(out) == 7 and all(r.verified for r in out)
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in out if r.payload_bytes > 99) == [(1, "response", None), (1, "response", None), (3, "revisit", 1)]
    assert {r.record_type for r in out if r.payload_bytes < 100} == {"response"}
    assert spark.read.parquet(path + "/payloads").count() == 3
    for r in warc.records_whole(spark, path).collect():
        head, _, block = bytes(r.record).decode().partition("\r\n\r\n")
        length = int(re.search(r"Content-Length: (\d+)", head)[1])
        kind = re.search(r"WARC-Type: (\w+)", head)[1]
        html = {"1": long, "2": "short", "3": long, "4": "short"}.get(re.search(r"WARC-Record-ID: <tag:corpuslake,2024:page/(\d)>", head)[1], "")
        http, _, body = block.partition("\r\n\r\n")
        assert http.startswith("HTTP/1.1 200 OK\r\n") and f"Content-Length: {len(html.encode())}" in http
        assert body == ("" if kind == "revisit" else html) and length == len(block.encode())
        assert head.count("WARC-Target-URI") == 1 and "\r\nX: y" not in head
    warc.warc_files(spark, path, str(tmp_path / "files"), compression="none")
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "files").glob("part-*")))
    assert text.count(b"WARC-Record-ID") == 7 and text.endswith(b"\r\n\r\n")
    assert warc.archive_round_trip(df.limit(0)).count() == 0
    assert shared_dir(spark)


def test_warc_notices_damage(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archive(spark.createDataFrame([(1, "u", "x" * 200)], "page_id long, url string, html string"), path)
    kept = spark.read.parquet(path + "/payloads").first()
    for digest, text in ((kept.digest, b"y" * 200), (kept.digest, b"y"), ("0" * 64, b"x" * 200)):
        spark.createDataFrame([(digest, 200, bytearray(zstandard.compress(text)))], "digest string, size long, packed binary").write.mode("overwrite").parquet(path + "/payloads")
        assert not warc.read_archive(spark, path).first().verified


def test_warc_without_ids(spark, tmp_path):
    long, other = "x" * 200, "y" * 200
    df = spark.createDataFrame([(None, "a", long), (7, "a", long), (None, "b", other), (None, "b", other), (None, None, None), (8, "c", None)], "page_id int, url string, html string")
    out = warc.archive_round_trip(df)
    assert dict(out.dtypes)["page_id"] == "int"
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.digest, r.payload_bytes) for r in out.collect()), key=str) == sorted([
        (None, "revisit", 7, digest(long), 200), (7, "response", None, digest(long), 200), (None, "response", None, digest(other), 200), (None, "response", None, digest(other), 200),
        (None, "response", None, digest(""), 0), (8, "response", None, digest(""), 0)], key=str)
    assert all(r.verified for r in out.collect())


def test_warc_ids_of_any_kind(spark, tmp_path):
    ids = ["a b", "ü/%2F+", "<x>", "", "\r\nX: y"]
    out = warc.archive_round_trip(spark.createDataFrame([(i, "u", "z" * 150) for i in ids], "page_id string, url string, html string")).collect()
    assert {r.page_id for r in out} == set(ids) and all(r.verified for r in out) and sum(r.record_type == "revisit" for r in out) == 4
    assert warc.page_of("<urn:uuid:1>") is None


# crf


def brute_crf(emit, trans, begin):
    import itertools

    n, k = emit.shape
    scores = {tags: begin[tags[0]] + sum(emit[i, t] for i, t in enumerate(tags)) + sum(trans[a, b] for a, b in zip(tags, tags[1:])) for tags in itertools.product(range(k), repeat=n)}
    z = np.logaddexp.reduce(list(scores.values()))
    marginal = np.zeros((n, k))
    for tags, s in scores.items():
        for i, t in enumerate(tags):
            marginal[i, t] += np.exp(s - z)
    return marginal, z, max(scores, key=scores.get)


def test_crf_against_enumeration():
    rng = np.random.default_rng(3)
    lengths = np.array([4, 0, 1, 5, 2])
    emit, trans, begin = rng.normal(size=(12, 3)) * 2, rng.normal(size=(3, 3)), rng.normal(size=3)
    steps = crf.Steps(lengths)
    marginal, _, total = crf.forward_backward(emit, trans, begin, steps)
    tags = crf.viterbi(emit, trans, begin, steps)
    at, z = 0, 0.0
    for n in lengths:
        if n:
            m, own, best = brute_crf(emit[at : at + n], trans, begin)
            assert np.allclose(marginal[at : at + n], m) and tuple(tags[at : at + n]) == best
            z += own
        at += n
    assert abs(total - z) < 1e-6


def test_crf_learns_order():
    # tag 1 follows each 0-feature token, whatever its own feature
    rng = np.random.default_rng(5)
    lengths = np.full(200, 8)
    f = rng.integers(0, 2, size=1600)
    tags = np.zeros(1600, np.int64)
    for i in range(1, 1600):
        if i % 8:
            tags[i] = f[i - 1]
    features = np.stack([f, 2 + np.where(np.arange(1600) % 8, np.roll(f, 1), 0)], axis=1)
    w, t, b = crf.train(features, tags, lengths, 4, 2)
    got = crf.viterbi(crf.emissions(features, w), t, b, crf.Steps(lengths))
    assert (got == tags).mean() > 0.97


# secrets


def brute_base(text):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    for k, (name, p, least) in enumerate((("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)), 1):
        out += [(m.start(), k, name, m.end()) for m in re.finditer(p, text) if m.end() - m.start() >= least]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_secret_base_and_more(spark):
    rng = random.Random(7)
    parts = ["password", "PassWd=", "secret", " : ", "=", "token", "'", '"', "api_key", "APIKEY=abcdef", "AKIA", "AKIA" + "A1" * 10, "0123456789abcdef" * 2, "abc", " ", "é😀", "\n", "ſecret=abcdefg", "toKen=abcdefg", "xyz123"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(300)] + [None, ""]
    model = secret_scan.fit(["plain words stand here and there"] * 20)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))
    out = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.spans] for r in secret_scan.scan(df, model).collect()}
    for i, t in enumerate(texts):
        base = brute_base(t or "")
        assert [s for s in out[i] if s[0] != "crf"] == base
        assert out[i] == sorted(out[i], key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))
        for kind, a, b in out[i]:
            assert kind != "crf" or not any(a < e and s < b for _, s, e in base)
    assert secret_scan.scan(df.limit(0)).count() == 0


def test_secret_crf_finds_what_patterns_miss(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = secret_scan.trained(docs)
    rng = random.Random(1)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    made = [f"the words around pwd: {''.join(rng.choice(alphabet) for _ in range(24))} go on" for _ in range(50)]
    found = secret_scan.tag_texts(secret_scan.Types(model), made)
    assert sum(bool(s) for s in found) >= 40
    clean = [r.text for r in docs.where("text not rlike '[0-9]'").select("text").limit(60).collect()]
    assert sum(bool(s) for s in secret_scan.tag_texts(secret_scan.Types(model), clean)) <= 6


def test_secret_crf_finds_short_ones(spark, sf_dir):
    model = secret_scan.trained(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rng = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    secrets = ["".join(rng.choice(alphabet) for _ in range(6 + k % 6)) for k in range(60)]
    made = [f"the words around {('pwd', 'credential', 'auth', 'login_key')[k % 4]}: {s} go on" for k, s in enumerate(secrets)]
    found = secret_scan.tag_texts(secret_scan.Types(model), made)
    assert sum(any(t[a:b] == s for a, b in f) for t, s, f in zip(made, secrets, found)) >= 40


def test_secret_parts_outside_base_spans():
    text = "pwd: ZZTOP9-" + "0123456789abcdef" * 2 + "-QX81PLM go on"
    assert secret_scan.outside(text, (5, 52), secret_scan.base_spans(text)) == [(5, 12), (44, 52)]
    assert secret_scan.outside(text, (5, 10), secret_scan.base_spans(text)) == [(5, 10)]
    assert secret_scan.outside(text, (12, 44), secret_scan.base_spans(text)) == []
    assert secret_scan.outside("(token=abcdefgh)", (0, 16), [(1, 15, 0), (3, 9, 1)]) == []


# toxicity


def toxic_rows(n, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeioutnrsl") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(10, 80))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["vilx", "NASTY", "grubb" + rng.choice(["a", "en", "ist"])]))
        out.append((i, " ".join(words), int(bad)))
    return out


def test_toxicity_held_out(spark):
    rows = toxic_rows(1500, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (10**9, 1, None)], "doc_id long, quality int, toxic int")
    assert toxicity.training_table(docs, labels).count() == sum(not toxicity.held_out(i) for i, _, _ in rows)
    model = toxicity.trained(docs, labels)
    out = {r._cl_id: r for r in toxicity.score(docs, model, with_spans=True).collect()}
    held = [(y, out[i].score >= 0.7) for i, _, y in rows if toxicity.held_out(i)]
    hit, said, there = sum(y and p for y, p in held), sum(p for _, p in held), sum(y for y, _ in held)
    assert hit / said > 0.97 and hit / there > 0.95
    text = rows[next(i for i, r in enumerate(rows) if "NASTY" in r[1].split())][1]
    spans = out[next(i for i, t, _ in rows if t == text)].spans
    assert any("NASTY" in text[s["start"] : s["end"]] for s in spans)
    kept = {r.doc_id for r in toxicity.reject_toxic(docs, labels).collect()}
    assert kept == {i for i in out if out[i].score < 0.7}


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(1, None), (None, ""), (2, "word " * 20_000), (2, "x")], "doc_id long, text string").withColumn("score", F.lit(1))
    assert toxicity.reject_toxic(df, labels).count() == 4
    model = toxicity.fit(["bad " * 3, "good"], [1, 0])
    assert all(0 <= r.score <= 1 for r in toxicity.score(df, model).collect())
    assert toxicity.score(df.limit(0), model).count() == 0


# pipeline


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline isn't here")
def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line dedup", "near-dedup", "mixing", "bpe"]
    columns = docs.columns
    ids = set(r.doc_id for r in docs.select("doc_id").collect())
    texts = {}
    for name, stage in cp.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns and docs.dtypes == before.dtypes
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids
        if name == "line dedup":
            assert now == ids
        ids = now
        texts = {r.doc_id: r.text for r in docs.collect()}
    out = cp.STAGES[-1][1](spark, docs, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r.doc_id for r in out.collect()} == set(texts)


PRIVATE = ["_cl_text", "_cl_row", "_cl_id", "_cl_source", "_cl_doc_row", "_cl_own", "_cl_lines", "kept_0", "id", "text_", "media", "won"]


def odd_documents(spark):
    """Nulls in every column, repeated rows, ties, a very long text, and columns named like those that operators use."""
    long = "a long line of this very long text, which only one document has\n" * 3000
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words here", None, "a", 3), (3, long, "de", None, 9), (4, "same text", "fr", "b", 9), (4, "same text", "fr", "b", 9), (5, "same text", None, "c", 9), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"mine {c}").alias(c) for c in PRIVATE])


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline isn't here")
def test_pipeline_with_odd_rows(spark, tmp_path):
    import corpus_pipeline as cp

    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None), (4, 0, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    now = docs
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        path = str(tmp_path / name.replace(" ", "-"))
        out.write.parquet(path)
        now = spark.read.parquet(path)
        assert all(r[c] == f"mine {c}" for r in now.collect() for c in PRIVATE), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        ids = sorted((str(r.doc_id) for r in now.select("doc_id").collect()))
        if name in ("toxicity", "line dedup"):
            assert ids == ["1", "2", "3", "4", "4", "5", "None", "None"], name
        if name == "near-dedup":
            assert ids == ["1", "3", "4", "None"]
    # what has no words takes no part in a mix
    assert {r.doc_id for r in now.collect()} <= {3, 4, None}
    last = cp.STAGES[-1][1]
    assert last(spark, now, str(tmp_path)).count() == now.count() and last(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert cp.run(spark, str(tmp_path)).count() == now.count()


def test_urls_with_private_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/1"), (2, None), (None, "x"), (2, None)], "page_id long, url string").select("*", *[F.lit(f"mine {c}").alias(c) for c in PRIVATE])
    out = url_filter.judge(pages, url_filter.rules_table(spark, [("block", "com", "/en/")]))
    assert out.columns == [*pages.columns, "host", "path", "rule", "verdict"]
    assert sorted((str(r.page_id), r.verdict) for r in out.collect()) == [("1", "block"), ("2", "allow"), ("2", "allow"), ("None", "allow")]
    assert all(r[c] == f"mine {c}" for r in out.collect() for c in PRIVATE)


def test_filter_follows_the_list(spark):
    assert url_filter.blocks_for(0) == url_filter.MIN_BLOCKS and url_filter.blocks_for(10**9) == url_filter.MAX_BLOCKS
    assert 16 * 10**6 <= url_filter.blocks_for(10**6) * 256 <= 64 * 10**6
    # one entry that nearly all pages may be listed by, without a broadcast
    small, url_filter.BROADCAST_BYTES = url_filter.BROADCAST_BYTES, -1
    try:
        pages = spark.range(5000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.com/en/"), F.col("id") % 900).alias("url"))
        out = url_filter.judge(pages, url_filter.rules_table(spark, [("block", "com", "/en/"), ("allow", "h.com", "/en/7")]))
        assert {(r.verdict, r["count"]) for r in out.groupBy("verdict").count().collect()} == {("allow", sum(str(i % 900).startswith("7") for i in range(5000))), ("block", sum(not str(i % 900).startswith("7") for i in range(5000)))}
    finally:
        url_filter.BROADCAST_BYTES = small
