"""Streaming forms: chunks and vectors of arriving sections, each session's last turns, a live token bucket."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Settings
from ..functions.text import repair, tidy
from ..operators import chunking, vectors
from ..operators.chunking import chunk_spans
from ..operators.service import Bucket


def stream_chunks(sections: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(paper_id, section_pos, pos, char_start, char_end) of cleaned sections as they arrive; no state."""
    clean = sections.withColumn("text", tidy(repair(F.col("text"))))
    return clean.select("paper_id", "section_pos", F.posexplode(chunk_spans(F.col("text"), settings.chunk_size, settings.chunk_overlap)).alias("pos", "span")).select("paper_id", "section_pos", "pos", F.col("span.start").alias("char_start"), F.col("span.end").alias("char_end"))


def _timeout(idle_ms: int | None) -> str:
    """State ends ``idle_ms`` after a key's last rows; only for streams that run on, since a run of what is available would wait for it."""
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def stream_last_turns(turns: DataFrame, n: int = 20, idle_ms: int | None = None) -> DataFrame:
    """(session_id, turn_no): the last ``n`` turns of a session after each batch that adds to it; with ``idle_ms`` idle sessions are forgotten."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        for frame in frames:
            kept += frame["turn_no"].tolist()
        kept = sorted(set(kept))[-n:]
        state.update((kept,))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"session_id": [key[0]] * len(kept), "turn_no": kept})

    return turns.select("session_id", "turn_no").groupBy("session_id").applyInPandasWithState(update, "session_id long, turn_no long", "kept array<long>", "update", _timeout(idle_ms))


def stream_token_bucket(calls: DataFrame, per_minute: int, idle_ms: int | None = None) -> DataFrame:
    """(key, seq, wait) of each call (key, seq, t); a key's bucket lives in its state; with ``idle_ms`` an idle one, full again by then, is dropped."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bucket = Bucket(per_minute)
        if state.exists:
            bucket.tokens, bucket.last = state.get
        rows = pd.concat(list(frames)).sort_values(["t", "seq"])
        out = [(key[0], int(seq), bucket.take(float(t))) for t, seq in zip(rows["t"], rows["seq"])]
        state.update((bucket.tokens, bucket.last))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["key", "seq", "wait"])

    return calls.select("key", "seq", "t").groupBy("key").applyInPandasWithState(update, "key long, seq long, wait double", "tokens double, last double", "append", _timeout(idle_ms))


def stream_index(sections: DataFrame, folder: str, checkpoint: str, embed_fn=vectors.hashed_embedding, settings: Settings = Settings(), **trigger) -> StreamingQuery:
    """Keep a folder of vectors, a partition a paper, up to date with arriving papers (paper_id, section_pos, title, text).

    All sections of a paper come in one batch; a paper that comes again is replaced whole, so a
    batch that is run twice after a failure changes nothing.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        chunks = chunking.chunk_sections(batch, settings)
        vectors.write_collections(vectors.embed(chunks, embed_fn=embed_fn), folder)

    writer = sections.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def event_counts(events: DataFrame, lateness: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Events a window and type, with a watermark; for monitoring."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


