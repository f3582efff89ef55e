import random

import pytest
from pyspark.sql import functions as F

from corpuslake.config import Settings
from corpuslake.operators import briefing, chunking, dialogue, layout, sections, service, state, vectors
from corpuslake.sources import tables


def pages_of(spark, texts, paper="p"):
    return spark.createDataFrame([(paper, i, t) for i, t in enumerate(texts)], "paper_id string, page_no int, text string")


# chunking


def random_text(rng):
    return "".join(rng.choice(["word ", "a", ". ", "\n", "\n\n", "! ", "long" * 9, " \n \n", "é"]) for _ in range(rng.randint(0, 120)))


def test_pieces_cover_the_text():
    rng = random.Random(3)
    bare = lambda t: "".join(t.split())
    for _ in range(300):
        text, size = random_text(rng), rng.choice([20, 50, 100])
        cuts = chunking.pieces(text, size)
        whole = [text[a:b] for a, b in cuts]
        assert bare("".join(whole)) == bare(text) and cuts == sorted(cuts)
        starts, ends = {a for a, _ in cuts}, {b for _, b in cuts}
        # only cuts of a long sentence, which touch, may begin or end with white space
        assert all(0 < len(p) <= size and (p == p.strip() or a in ends or b in starts) for p, (a, b) in zip(whole, cuts))
        # a piece ends at a paragraph's, line's or sentence's end, or is a full cut
        for p, (_, b) in zip(whole, cuts):
            rest = text[b:]
            assert not rest.strip() or rest.startswith(("\n", " ")) or len(p) == size


def test_chunks_are_greedy():
    """Each chunk ends with a piece, as far on as ``size`` allows, and takes one new piece at least; the next one overlaps it."""
    rng = random.Random(5)
    for _ in range(300):
        text, size, overlap = random_text(rng), rng.choice([20, 50, 100]), rng.choice([0, 15])
        ends = [b for _, b in chunking.pieces(text, size)]
        chunks = chunking.pack(text, size, overlap)
        assert bool(chunks) == bool(ends)
        if not chunks:
            continue
        assert chunks[0][0] == chunking.pieces(text, size)[0][0] and chunks[-1][1] == ends[-1]
        for (a, b), (c, _) in zip(chunks, chunks[1:]):
            assert c == max(b - overlap, 0)
        reached = 0
        for a, b in chunks:
            taken = [e for e in ends if reached < e <= b]
            assert taken and taken[-1] == b
            assert b - a <= size or len(taken) == 1
            following = [e for e in ends if e > b]
            assert not following or following[0] - a > size
            reached = b


def test_pieces_as_expressions(spark):
    rng = random.Random(7)
    texts = [random_text(rng) for _ in range(60)] + ["", " \n ", "One. Two! Three?", "x" * 130]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", chunking.atomic_pieces(F.col("t"), 50).alias("p")).collect():
        assert r.p == [r.t[a:b] for a, b in chunking.pieces(r.t, 50)]


def test_chunk_invariants():
    text = "\n\n".join(f"Paragraph {i} has some words of its own." for i in range(6))
    spans = chunking.pack(text, 100, 15)
    assert len(spans) > 1 and all(b - a <= 120 for a, b in spans)
    assert all(text[a:].startswith(text[pb - 15 : pb]) for (_, pb), (a, _) in zip(spans, spans[1:]))
    assert all(b - a <= 60 for a, b in chunking.pack("x" * 200, 50, 10))
    assert chunking.pack("", 50, 10) == [] and chunking.pack(" \n ", 50, 10) == []


def test_chunk_sections(spark):
    rows = [("p", 0, "Introduction", "word " * 30), ("p", 1, "Method", "other " * 30), ("p", 2, "X", "short")]
    out = chunking.chunk_sections(spark.createDataFrame(rows, "paper_id string, section_pos int, title string, text string")).orderBy("chunk_index").collect()
    assert [r.chunk_id for r in out] == ["introduction-0", "method-1"] and out[0].text.startswith("[Introduction] word")
    bare = chunking.with_abstract_fallback(spark.createDataFrame([], "paper_id string, chunk_id string, text string, section_title string, chunk_index int, char_start int, char_end int, token_estimate int"), spark.createDataFrame([("q", "abc")], "paper_id string, full_text string")).first()
    assert bare.chunk_id == "abstract-0" and bare.text == "[Abstract] abc" and bare.degraded


# sections


def test_table_rows_are_no_headings(spark):
    text = "2 Survey Of Rivers\nthey flow\n64.1 Okafor et al. say so\n3.1 Water Levels\n12.5 Gauge (1987b)\n1999 Was Dry\n4.07 Padded Row\n5 Lakes [12]\n3.2 Flow Rates\n44.9 Basin Three\nmore\n20 Last Words\nend"
    out = sections.detect_sections(pages_of(spark, [text])).orderBy("section_pos").collect()
    assert [r.title for r in out] == ["2 Survey Of Rivers", "3.1 Water Levels", "3.2 Flow Rates", "20 Last Words"]
    assert out[0].text.startswith("they flow\n64.1") and [r.level for r in out] == [1, 2, 2, 1] and out[3].text == "end"


def test_sections_fall_back_and_keep_pages(spark):
    one = sections.detect_sections(pages_of(spark, ["no heads", "here"])).collect()
    assert [(r.title, r.text) for r in one] == [("Full Text", "no heads\n\nhere")]
    heads = ["1 Introduction\na", "2 Method\nb", "3 Results\nc", "4 Conclusion\nd"]
    numbered = spark.createDataFrame([("p", n, t) for n, t in zip([0, 5, 6, 9], heads)], "paper_id string, page_no int, text string")
    assert [(r.title, r.start_page) for r in sections.detect_sections(numbered).orderBy("section_pos").collect()] == [("1 Introduction", 0), ("2 Method", 5), ("3 Results", 6), ("4 Conclusion", 9)]


def test_keyword_and_font_headings(spark):
    pages = pages_of(spark, ["Abstract:\nx\nRelated Work\ny\nA Large Line\nz\n  Conclusion  \nw"])
    fonts = spark.createDataFrame([("p", "A Large Line"), ("p", "Abstract:")], "paper_id string, title string")
    out = sections.detect_sections(pages, fonts).orderBy("section_pos").collect()
    assert [(r.title, r.text) for r in out] == [("Abstract", "x"), ("Related Work", "y"), ("A Large Line", "z"), ("Conclusion", "w")]


def test_references(spark):
    made = spark.createDataFrame([("p", 0, "Method", "m"), ("p", 1, "7 References", "[1] A. Author. Title. 2020.\n[2] B. Author.\nOther. 2021."), ("p", 2, "Appendix", "a"), ("p", 3, "Late", "b")], "paper_id string, section_pos int, title string, text string")
    body, refs = sections.split_references(made)
    assert [r.title for r in body.collect()] == ["Method"]
    assert refs.select(sections.reference_entries(F.col("text"))).first()[0] == ["A. Author. Title. 2020.", "B. Author. Other. 2021."]
    lines = spark.createDataFrame([("One entry\n\nTwo entry",), ("",)], "text string").select(sections.reference_entries(F.col("text")).alias("e")).collect()
    assert [r.e for r in lines] == [["One entry", "Two entry"], []]


def test_abstract(spark):
    papers = spark.createDataFrame([("a", " given "), ("b", " "), ("c", None)], "paper_id string, abstract string")
    found = spark.createDataFrame([("a", 0, "Abstract", "found", 1, 0), ("b", 0, "Abstract", "found ", 1, 0)], "paper_id string, section_pos int, title string, text string, level int, start_page int")
    told = sections.resolve_abstract(papers, found)
    assert dict(map(tuple, told.collect())) == {"a": "given", "b": "found", "c": ""}
    out = sections.prepend_abstract(found.where("paper_id = 'b'").unionByName(found.limit(0)), spark.createDataFrame([("a", "given"), ("b", "new")], "paper_id string, abstract string"))
    assert {(r.paper_id, r.title, r.text) for r in out.collect()} == {("a", "Abstract", "given"), ("b", "Abstract", "new")}


def test_repeated_lines_and_page_numbers(spark):
    text = "Running Header\nbody one\n42\nRunning Header\nbody two\n\nRunning Header\nbody three"
    out = sections.drop_repeated_lines(spark.createDataFrame([("p", text), ("q", "Some content\n42\nMore content"), ("r", None)], "paper_id string, text string"))
    assert dict(map(tuple, out.collect())) == {"p": "body one\nbody two\n\nbody three", "q": "Some content\nMore content", "r": ""}


def test_truncate_pages(spark):
    texts = [f"page {i}" for i in range(10)]
    texts[8] = "5 Conclusion\nend"
    kept = sections.truncate_pages(pages_of(spark, texts), 3)
    assert sorted(r.page_no for r in kept.collect()) == [0, 1, 2, 8]


def test_merge_is_greedy(spark):
    rows = [("p", 0, pos, t, 1, prio) for pos, t, prio in [(0, "a", 0), (2, "b", 1), (4, "c", 1), (4, "d", 2), (6, "e", 0), (7, "f", 0)]]
    shape = "paper_id string, page_no int, pos long, title string, level int, priority int"
    out = sections.merge_candidates(spark.createDataFrame(rows, shape))
    assert [r.title for r in out.orderBy("pos").collect()] == ["a", "c", "f"]
    rng = random.Random(9)
    places = [(f"p{k}", 0, pos, f"t{pos}-{prio}", 1, prio) for k in range(20) for pos, prio in {(rng.randrange(60), rng.randrange(3)) for _ in range(30)}]
    got = {}
    for r in sections.merge_candidates(spark.createDataFrame(places, shape)).collect():
        got.setdefault(r.paper_id, set()).add((r.pos, r.title))
    for paper in got:
        last, want = -9, set()
        for _, _, pos, title, _, prio in sorted((x for x in places if x[0] == paper), key=lambda x: (x[2], x[5])):
            if pos - last >= 3:
                want.add((pos, title))
                last = pos
        assert got[paper] == want


# layout


def test_columns(spark):
    places = [(40, 10, "l1"), (300, 10, "r1"), (41, 20, "l2"), (301, 20, "r2"), (40, 30, "l3")]
    blocks = spark.createDataFrame([("p", 0, float(x), float(y), t, 0) for x, y, t in places] + [("p", 0, 1.0, 1.0, "image", 1), ("q", 0, 40.0, 20.0, "b", 0), ("q", 0, 300.0, 10.0, "a", 0)], "paper_id string, page_no int, x0 double, y0 double, text string, block_type int")
    assert {r.paper_id: r.text for r in layout.page_texts(blocks).collect()} == {"p": "l1\nl2\nl3\nr1\nr2", "q": "a\nb"}


def test_font_headings(spark):
    lines = spark.createDataFrame([("p", i, s, t) for i, (s, t) in enumerate([(10.0, "body"), (10.0, "more"), (14.0, "Heading"), (14.0, "Heading"), (20.0, "no"), (10.0, "rest"), (10.0, "rest"), (10.0, "last")])], "paper_id string, line_no int, size double, text string")
    assert [(r.title, r.line_no) for r in layout.font_headings(lines).collect()] == [("Heading", 2)]


# vectors


def test_search(spark):
    v = spark.createDataFrame([("c0", [1.0, 0.0], "x"), ("c1", [0.0, 1.0], "x"), ("c2", [3.0, 4.0], "y"), ("c3", None, "y")], "chunk_id string, embedding array<float>, paper string")
    out = [(r.chunk_id, r.score) for r in vectors.search(v, [("q", [1.0, 0.0])], 2).orderBy("rank").collect()]
    assert out == [("c0", 1.0), ("c2", 0.6)]
    own = vectors.search(v, [("q", [1.0, 0.0], "y"), ("r", [1.0, 0.0], "none")], 5, collection_col="paper").collect()
    assert [(r.query_id, r.chunk_id) for r in own] == [("q", "c2")]
    assert vectors.search(v, [("q", [1.0, 0.0])], 1, metric="dot").first().chunk_id == "c2"
    assert vectors.search(v, [], 2).count() == 0


def test_search_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(700, 4)), 1).astype(np.float32)  # coarse, so that scores tie
    x[:90] = x[0]
    rows = [(i, [float(a) for a in v], i % 3) for i, v in enumerate(x)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>, part long").repartition(5)
    asked = [(i, rows[i][1], rows[i][2]) for i in (0, 7, 300)]
    wide = x.astype(np.float64)
    unit = wide / np.linalg.norm(wide, axis=1, keepdims=True)
    table = spark.createDataFrame(asked, "q long, v array<double>, part long")
    for k in (1, 5, 800):
        for own in (False, True):
            want = {}
            for q, _, part in asked:
                scored = sorted((-round(float(unit[i] @ unit[q]), 6), i) for i in range(700) if not own or i % 3 == part)
                want[q] = [i for _, i in scored[:k]]
            for queries in (asked, table):
                got = {}
                for r in vectors.search(v, queries, k, id_col="id", collection_col="part" if own else None).orderBy("rank").collect():
                    got.setdefault(r.query_id, []).append(r.id)
                assert got == want
    small = vectors.QUERY_BYTES
    try:
        vectors.QUERY_BYTES = 40  # a block a query or two
        assert vectors.search(v, asked, 3, id_col="id").count() == 9
    finally:
        vectors.QUERY_BYTES = small
    joined = vectors.search_own(v, table.select(F.col("q").alias("query_id"), F.col("v").alias("vector"), "part"), 5, collection_col="part", id_col="id")
    assert {r.id for r in joined.where("query_id = 7").collect()} == set(sorted((i for i in range(700) if i % 3 == 1), key=lambda i: (-round(float(unit[i] @ unit[7]), 6), i))[:5])


def test_floor_dedupe_and_order(spark):
    rows = [("q", 5, 0.9, 1, "same  TEXT"), ("q", 2, 0.8, 2, "same text"), ("q", 1, 0.7, 3, "other"), ("q", 0, 0.2, 4, "low")]
    h = spark.createDataFrame(rows, "query_id string, chunk_index int, score double, rank int, text string")
    from corpuslake.functions.text import prefix_key

    out = vectors.floor_and_dedupe(h, 0.3, prefix_key(F.col("text")), order_col="chunk_index").orderBy("passage").collect()
    assert [(r.chunk_index, r.passage) for r in out] == [(1, 1), (5, 2)]


def test_choose(spark):
    ranked = spark.createDataFrame([("a", "x", 0.9, 1), ("a", "y", 0.5, 2), ("b", "x", 0.2, 1), ("b", "y", 0.1, 2), ("b", "z", 0.1, 3), ("b", "w", 0.0, 4)], "query_id string, id string, score double, rank int")
    out = {r.query_id: r for r in vectors.choose(ranked, confidence=0.35, pool=5).collect()}
    assert (out["a"].selected, out["a"].action, out["a"].candidates) == ("x", "proceed", None)
    assert (out["b"].selected, out["b"].action, out["b"].candidates) == (None, "confirm_with_user", ["x", "y", "z"])


def test_embed_search_near_its_floor(spark, tmp_path):
    """A cosine that is 0.8 only if rounded doesn't count; a text without words is no query and is near to none."""
    from corpuslake.plans import catalogue

    def places(counts):
        return [w for w, n in counts for _ in range(n)]

    # two words of different places: the cosine of (1, 0) and (4, 3) is 0.8, that of (4000, 3001) is 0.79987, of (400000, 300001) 0.7999995
    rows = [(0, "one"), (1, " ".join(places([("one", 400_000), ("two", 300_001)]))), (2, " ".join(places([("one", 400_001), ("two", 300_000)]))), (100, " "), (200, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalogue.queries()["embed_search"](spark, str(tmp_path)).collect()))
    assert got == [(0, 2, 1.0)]


def test_near_counts_over_blocks(spark, monkeypatch):
    rng = random.Random(23)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(90)] + [(90, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    monkeypatch.setattr(vectors, "QUERY_BYTES", 100)
    want = {i: [sum(a * b for a, b in zip(x, y)) for _, y in rows[:90]] for i, x in rows[:90] if i % 10 == 0}
    got = {r.query_id: r for r in vectors.near_counts(df, df.where("id % 10 = 0 AND embedding IS NOT NULL"), 0.3).collect()}
    assert got.keys() == want.keys()
    assert all(got[i].near == sum(s >= 0.3 for s in w) and got[i].best == pytest.approx(max(w)) for i, w in want.items())
    assert vectors.near_counts(df, df.limit(0), 0.3).count() == 0


def test_embed_and_collections(spark):
    df = vectors.embed(spark.createDataFrame([("p", "a b a"), ("p", None)], "paper_id string, text string"))
    a, b = [r.embedding for r in df.collect()]
    assert abs(sum(x * x for x in a) - 1) < 1e-6 and sum(map(abs, b)) == 0
    assert vectors.stale_collections(df, df.limit(1)).count() == 1 and vectors.stale_collections(df, df).count() == 0
    assert vectors.upsert(df, df.limit(1)).count() == 1
    with pytest.raises(Exception, match="without a vector"):
        vectors.upsert(df, df.withColumn("embedding", F.lit(None).cast("array<float>"))).collect()


def test_embedders_that_fail(spark, tmp_path):
    from corpuslake.operators.service import EmbeddingError

    def picky(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [[3.0, 4.0] for _ in texts]

    df = spark.createDataFrame([("p", "fine"), ("q", "bad")], "paper_id string, text string").repartition(2, "paper_id")
    out = {r.paper_id: (r.embedding, r.error) for r in vectors.embed(df, embed_fn=picky, batch=1, error_col="error").collect()}
    assert [round(x, 6) for x in out["p"][0]] == [0.6, 0.8] and out["p"][1] is None and out["q"][0] is None and "no" in out["q"][1]
    with pytest.raises(Exception, match="EmbeddingError"):
        vectors.embed(df, embed_fn=picky).collect()
    with pytest.raises(EmbeddingError):
        vectors._unit([], 1)
    marks = tmp_path / "loads"

    def load():
        with open(marks, "a") as f:
            f.write("x")
        return lambda texts: [[1.0] for _ in texts]

    vectors.embed(spark.createDataFrame([(str(i),) for i in range(50)], "text string").coalesce(1), embed_fn=vectors.LazyModel("test", load), batch=3).collect()
    assert marks.read_text() == "x"
    folder = str(tmp_path / "vectors")
    vectors.write_collections(spark.createDataFrame([("p", 1, [1.0]), ("q", 1, [1.0])], "paper_id string, n int, embedding array<double>"), folder)
    vectors.write_collections(spark.createDataFrame([("q", 2, [1.0])], "paper_id string, n int, embedding array<double>"), folder)
    assert sorted((r.paper_id, r.n) for r in spark.read.parquet(folder).collect()) == [("p", 1), ("q", 2)]


# dialogue, briefing


def test_answer_ladder(spark):
    rows = spark.createDataFrame([(0, "m", "x [1]", None), (2, "none", None, None), (2, "m", None, "busy"), (2, "m", "NOT_IN_PAPER.", None), (2, "m", "x [1]", None)], "n int, model string, response string, failure string")
    told = dialogue.answer_ladder(F.col("n"), F.col("model"), F.col("response"), F.col("failure"), F.lit("[1] (A) t"), F.array(F.lit("A"), F.lit("B")))
    assert [tuple(r.t) for r in rows.select(told.alias("t")).collect()] == [
        (dialogue.REFUSAL, False), (dialogue.NO_MODEL + "\n\n[1] (A) t", True), ("Could not get an answer right now: busy", False), (dialogue.REFUSAL + " Closest sections checked: A, B.", False), ("x [1]", True)]


def test_history(spark):
    t = spark.createDataFrame([(1, i, f"q{i}", f"a{i}") for i in range(5)], "session_id int, turn_no int, question string, answer string")
    out = {r.turn_no: r.history for r in dialogue.with_history(t).collect()}
    assert out[0] == dialogue.NO_HISTORY and out[4] == "Q: q1\nA: a1\n\nQ: q2\nA: a2\n\nQ: q3\nA: a3"
    assert sorted(r.turn_no for r in dialogue.last_turns(t, 2).collect()) == [3, 4]


def test_priority_is_not_taken_twice(spark):
    titles = ["Methods and Results", "Introduction", "Evaluation", "Abstract", "Discussion", "Conclusion"]
    s = spark.createDataFrame([("p", i, t, "x" * 300) for i, t in enumerate(titles)] + [("q", 0, "A", "y")], "paper_id string, section_pos int, title string, text string")
    chosen = briefing.priority_sections(s)
    assert [r.title for r in chosen.where("paper_id = 'p'").orderBy("priority").collect()] == ["Abstract", "Introduction", "Methods and Results", "Evaluation", "Discussion"]
    out = {r.paper_id: r for r in briefing.build_context(chosen, 500).collect()}
    assert out["p"].strategy == "map_reduce" and out["q"].strategy == "single_pass" and out["q"].context == "[A]\ny"


def test_bullets(spark):
    rows = spark.createDataFrame([("- a\n• b \ntext", "t", False), ("plain", "t", False), (None, " text ", True)], "r string, t string, f boolean")
    assert [r[0] for r in rows.select(briefing.bullets(F.col("r"), F.col("t"), F.col("f"))).collect()] == [["a", "b"], ["plain"], ["text"]]


def test_markdown_and_notes(spark):
    b = {"title": F.lit("T"), "authors": F.array(F.lit("A"), F.lit("B")), "paper_id": F.lit("1"), "published": F.lit("2024-01-02").cast("date"), "link": F.lit("L"), "why_it_matters": F.lit("W"), "problem_statement": F.lit("P"), "method": F.array(F.lit("m")), "key_results": F.array(F.lit("k")), "limitations": F.array(F.lit("l")), "followup_questions": F.array(F.lit("f")), "confidence_notes": F.lit("N")}
    got = spark.range(1).select(briefing.render_markdown(b), briefing.violations(b), briefing.render_json(b)).first()
    assert got[0] == "# T\n\n**Authors:** A, B  \n**arXiv ID:** 1  \n**Published:** 2024-01-02  \n**Link:** L\n\n> **Note:** N\n\n## Why It Matters\n\nW\n\n## Problem Statement\n\nP\n\n## Method\n\n- m\n\n## Key Results\n\n- k\n\n## Limitations\n\n- l\n\n## Suggested Follow-up Questions\n\n- f\n"
    assert got[1] == ["why_it_matters", "method", "key_results", "followup_questions"]
    assert service.parse_json(got[2])["authors"] == ["A", "B"]
    note = spark.range(1).select(briefing.confidence_notes(F.lit("map_reduce"), F.lit(5), F.lit(0.2), F.lit("x"), F.lit("own"))).first()[0]
    assert note.startswith("Long paper: summarized via map-reduce over 5 sections") and note.endswith("reliable. own")


# services, state, sources


def test_retry():
    calls, waits = [], []

    def failing(n, retryable=True):
        def call():
            calls.append(1)
            if len(calls) <= n:
                raise service.ServiceError("x", retryable=retryable)
            return "ok"

        return call

    assert service.call_with_retry(failing(1), (1, 2, 4), waits.append) == "ok" and waits == [1]
    calls.clear()
    with pytest.raises(service.ServiceError):
        service.call_with_retry(failing(9, False), (1, 2, 4), waits.append)
    assert len(calls) == 1
    calls.clear()
    with pytest.raises(service.ServiceError):
        service.call_with_retry(failing(9), (1, 2, 4), waits.append)
    assert len(calls) == 4


def test_complete_and_cache(spark):
    class Echo:
        name, max_context_tokens = "echo", 8000

        def complete(self, system, user, temperature=0.2):
            if user == "bad":
                raise service.ServiceError("no", user_message="sorry")
            return f"{system}/{user}"

    asked = spark.createDataFrame([("m", "s", "u"), ("m", "s", "u"), ("m", "s", "bad"), ("m", "s", "old")], "model string, system string, user string")
    cache = asked.where("user = 'old'").select(service.cache_key(F.col("model"), F.col("system"), F.col("user")).alias("key"), F.lit("kept").alias("response"))
    out, fresh = service.complete(asked, cache, Echo(), Settings(retry_delays=()))
    assert sorted((r.user, r.response, r.failure) for r in out.collect()) == [("bad", None, "sorry"), ("old", "kept", None), ("u", "s/u", None), ("u", "s/u", None)]
    assert [r.response for r in fresh.collect()] == ["s/u"]
    with pytest.raises(service.ServiceError):
        service.NoClient().complete("", "")


def test_bucket():
    assert [round(w, 6) for w, _ in service.replay_bucket([0.0] * 7, 5)] == [0, 0, 0, 0, 0, 12, 24]
    assert service.replay_bucket([0.0, 600.0], 5)[1] == (0.0, 4.0)


def test_state(spark):
    u = spark.createDataFrame([("t", 1, ["a", "b"], "1", "x"), ("t", 2, ["a"], None, "ignored"), ("t", 3, ["b"], "ignored", "y"), ("s", 1, [], "9", "9")], "thread_id string, seq int, set_fields array<string>, a string, b string")
    out = {r.thread_id: (r.seq, r.a, r.b) for r in state.restore(state.merge_updates(u, ["a", "b"])).collect()}
    assert out == {"t": (3, None, "y"), "s": (1, None, None)}


def test_map_results_and_lookup(spark):
    raw = spark.createDataFrame([("http://arxiv.org/abs/2405.00017v3", "Rivers\n of  Sand", ["A"], " s  t ", "2023-01-02 03:04:05", None, ["cs"], None, "")], "entry_id string, title string, authors array<string>, summary string, published string, updated string, categories array<string>, pdf_url string, doi string")
    papers = tables.map_results(raw.withColumn("published", F.to_timestamp("published")).withColumn("updated", F.to_timestamp("updated")))
    r = papers.first()
    assert (r.paper_id, r.title, r.abstract, str(r.published), r.updated, r.doi) == ("2405.00017", "Rivers of Sand", "s t", "2023-01-02", None, None)
    found = {r.paper_id: (r.paper is not None, r.error) for r in tables.lookup(papers, spark.createDataFrame([("2405.00017",), ("0",)], "paper_id string")).collect()}
    assert found["2405.00017"] == (True, None) and found["0"][1] == "No paper has the ID 0."


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    (tmp_path / "c.txt").write_bytes(b"%PDF")
    got = {r.path.rsplit("/", 1)[1]: r.valid for r in tables.landed_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": True, "b.pdf": False}
    large = {r.path.rsplit("/", 1)[1]: (r.content, r.error) for r in tables.landed_files(spark, str(tmp_path), Settings(max_file_mb=0)).collect()}
    assert all(c is None and "larger" in e for c, e in large.values()) and len(large) == 2
    assert tables.folder_sizes(spark, str(tmp_path)).first()["bytes"] == 20
    out = str(tmp_path / "out")
    made = spark.createDataFrame([("cs/1", "# T", "{}")], "paper_id string, markdown string, json string")
    tables.save_briefings(made, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).first().paper_id == "cs/1"
    tables.export_briefings(made, out)
    assert spark.read.text(out + "/markdown").first()["value"] == "# T"
    assert tables.evict(spark, out, "markdown/paper=cs_1") and tables.evict(spark, out) and not tables.evict(spark, out)
    ck = str(tmp_path / "ck")
    for n in (1, 2):
        tables.append_checkpoint(spark.createDataFrame([("t", n, f"v{n}")], "thread_id string, seq int, a string"), ck)
    assert state.restore(spark.read.parquet(ck)).first()["a"] == "v2"


def test_fetched_files(spark):
    def get(url):
        if url == "down":
            raise OSError("no route")
        yield {"good": b"%PDF", "html": b"<htm", "large": b"%PDF"}[url]
        for _ in range(40 if url == "large" else 1):
            yield b"x" * (1 << 16)

    papers = spark.createDataFrame([(u, u) for u in ("good", "html", "large", "down", "had")], "paper_id string, pdf_url string")
    landed = spark.createDataFrame([("had",)], "paper_id string")
    out = {r.paper_id: r for r in tables.fetch_files(papers, landed, get, Settings(max_file_mb=1)).collect()}
    assert set(out) == {"good", "html", "large", "down"} and len(out["good"].content) == 4 + (1 << 16) and out["good"].error is None
    assert "PDF" in out["html"].error and "larger" in out["large"].error and "no route" in out["down"].error and out["large"].content is None


def test_phrases(spark):
    texts = spark.createDataFrame([("a", "aaaa bb a"), ("b", ""), ("c", None), ("d", "éa bb")], "paper_id string, text string")
    phrases = spark.createDataFrame([("aa",), ("a",), ("bb",), ("",), ("zz",), ("aa",)], "phrase string")
    got = {(r.paper_id, r.phrase): r.n for r in tables.find_phrases(texts, phrases).collect()}
    assert got == {("a", "aa"): 2, ("a", "a"): 5, ("a", "bb"): 1, ("d", "a"): 1, ("d", "bb"): 1}
    papers = spark.createDataFrame([(i, "Title", f"word{i % 7} and word{i % 3}") for i in range(50)], "paper_id long, title string, abstract string")
    many = spark.createDataFrame([(q, [f"word{q % 7}", "title"]) for q in range(12_000)], "query_id long, terms array<string>")
    found = tables.search_catalogue(papers, many, 3)
    assert found.count() == 36_000
    small, tables.PHRASE_CHARS = tables.PHRASE_CHARS, 1
    try:
        assert tables.search_catalogue(papers, many.limit(10), 3).count() == 30
    finally:
        tables.PHRASE_CHARS = small


def test_client_chain():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    class Echo:
        name, max_context_tokens = "echo", 10

        def complete(self, system, user, temperature=0.2):
            return user

    limited = service.Limited(Echo(), 5, lambda: now[0], sleep)
    assert [limited.complete("", str(i)) for i in range(7)] == list("0123456") and slept == [12.0, 12.0]
    assert service.build_client(None).name == "none"
    chain = service.build_client(Echo)
    assert (chain.name, chain.max_context_tokens, type(chain.client).__name__) == ("echo", 10, "Limited")


def test_bucket_over_a_table(spark):
    rows = [(k, i, float(t)) for k in range(3) for i, t in enumerate([0, 0, 0, 1, 1, 2, 2, 50, 50])] + [(9, 0, 5.0)]
    out = service.token_bucket(spark.createDataFrame(rows, "key long, seq long, t double").repartition(4), 5).collect()
    for k in {r[0] for r in rows}:
        want = service.replay_bucket([t for key, _, t in rows if key == k], 5)
        assert [(r.wait, r.tokens) for r in sorted(out, key=lambda r: r.seq) if r.key == k] == want


def test_settings(monkeypatch):
    monkeypatch.setenv("CORPUSLAKE_TOP_K", "7")
    assert Settings.from_env().top_k == 7 and Settings().budget_chars(None) == 16000 and Settings().budget_chars(100) == 4000
