from pyspark.sql import functions as F

from corpuslake.operators.chunking import chunk_spans
from corpuslake.operators.service import replay_bucket
from corpuslake.streaming import streams


def run(query_df, name, mode, spark, tmp_path):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_streams_agree_with_batches(spark, tmp_path):
    docs = spark.createDataFrame([("p", i, "Some words here. " * (20 * i + 1)) for i in range(4)], "paper_id string, section_pos int, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    got = run(streams.stream_chunks(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs"))), "chunks", "append", spark, tmp_path)
    want = docs.select("paper_id", "section_pos", F.explode(chunk_spans(F.trim("text"), 1000, 150)).alias("s")).select("paper_id", "section_pos", "s.start", "s.end")
    assert sorted((r.section_pos, r.char_start, r.char_end) for r in got.collect()) == sorted((r.section_pos, r.start, r.end) for r in want.collect())

    calls = spark.createDataFrame([(1, i, 2.0 * i) for i in range(9)], "key long, seq long, t double")
    calls.write.parquet(str(tmp_path / "calls"))
    got = run(streams.stream_token_bucket(spark.readStream.schema(calls.schema).parquet(str(tmp_path / "calls")), 5), "waits", "append", spark, tmp_path)
    waits = [round(r.wait, 6) for r in got.orderBy("seq").collect()]
    assert waits == [round(w, 6) for w, _ in replay_bucket([2.0 * i for i in range(9)], 5)]

    turns = spark.createDataFrame([(1, i) for i in range(30)], "session_id long, turn_no long")
    turns.coalesce(1).write.parquet(str(tmp_path / "turns"))
    got = run(streams.stream_last_turns(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "turns")), 20), "last", "update", spark, tmp_path)
    assert sorted(r.turn_no for r in got.collect()) == list(range(10, 30))


def test_stream_index_replaces_papers(spark, tmp_path):
    shape = "paper_id string, section_pos int, title string, text string"
    first = spark.createDataFrame([("p", 0, "A", "words of the first version " * 80), ("q", 0, "B", "words of another paper " * 10)], shape)
    first.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(first.schema).parquet(str(tmp_path / "in"))
    folder = str(tmp_path / "vectors")
    streams.stream_index(stream, folder, str(tmp_path / "ck"), availableNow=True).awaitTermination()
    before = {r.paper_id: r["count"] for r in spark.read.parquet(folder).groupBy("paper_id").count().collect()}
    assert before["p"] > 1 and before["q"] == 1
    spark.createDataFrame([("p", 0, "A", "a shorter version of the paper, with enough words to be a chunk")], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    streams.stream_index(stream, folder, str(tmp_path / "ck"), availableNow=True).awaitTermination()
    after = spark.read.parquet(folder)
    assert {r.paper_id: r["count"] for r in after.groupBy("paper_id").count().collect()} == {"p": 1, "q": 1}
    assert "shorter" in after.where("paper_id = 'p'").first().text
