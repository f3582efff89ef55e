"""BPE encoding and decoding with tree concatenation.

A text of up to ``leaf_chars`` is encoded at once.  A longer text is halved again and again;
the leaves are encoded in parallel, anywhere on the cluster, and met pairwise: a window
around the join is encoded anew and grows until its tokens agree with both sides, which
then are cut and put together.  A window that reaches the end of a side replaces it, so the
result is exact in any case.

Why agreement suffices: the pre-tokenizer reads from left to right and keeps no state past a
word end, and within a word BPE's result is the only sequence whose neighbouring tokens are
each the encoding of their pair; where two encodings share a run of tokens at the same
places, the left part of one and the right part of the other form such a sequence.

A tokenizer that drops white space encodes the parts between blanks independently; these
parts are kept with their ids in a bounded memory of each worker.
"""

from __future__ import annotations

import os
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, small_batches, text_of

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

LEAF_CHARS = 32768
FIRST_WINDOW = 64
#: Tokens that a window and a side must share in a row.
AGREE = 4
#: Parts between blanks that a worker remembers, twice: those in use and those before.
MEMORY = 150_000
#: Blanks that no word and no mark contains.
BLANKS = (" ", "\n", "\t", "\r")

_coders: dict[int, Coder] = {}


class Coder:
    """A tokenizer file's encoder and decoder, with the memory of a worker."""

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        self.tok = tok = Tokenizer.from_str(spec.decode("utf-8"))
        tok.no_truncation()
        tok.no_padding()
        ids = lambda t: tok.encode(t, add_special_tokens=False).ids
        self.drops_space = not ids(" \n") and ids(" \n\t a \n b") == ids("a b")
        self.pieces = [tok.id_to_token(i) for i in range(tok.get_vocab_size(with_added_tokens=True))]
        self.plain_decode = tok.decoder is None
        suffix = getattr(tok.model, "end_of_word_suffix", None)
        self.word_end = np.array([bool(suffix and p and p.endswith(suffix)) for p in self.pieces])
        # words in letters may be looked up without the marks behind them, and in lower case
        self.bare_words = bool(suffix) and self.drops_space and ids("Ab.,") == ids("ab") + ids(".,")
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.drops_space:
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        try:
            known = self.known
            return b"".join([known[p] for p in parts])
        except KeyError:
            self._learn(parts)
        known = self.known
        return b"".join([known[p] for p in parts])

    def _learn(self, parts: list[str]) -> None:
        """Put all ``parts`` into the memory; when that is full, only what is in use stays in it."""
        if len(self.known) > MEMORY:
            self.known, self.older = {"": b""}, self.known
        known, older = self.known, self.older
        new = {p for p in parts if p not in known}
        words: dict[str, tuple[str, str]] = {}
        whole = []
        for p in new:
            if p in older:
                known[p] = older[p]
            elif self.bare_words and p.isascii() and (word := p.rstrip(".,;:!?")).isalpha():
                words[p] = (word.lower(), p[len(word) :])
            else:
                whole.append(p)
        whole += {tail for _, tail in words.values() if tail not in known}
        for p, e in zip(whole, self.tok.encode_batch(whole, add_special_tokens=False) if whole else []):
            known[p] = np.array(e.ids, "<u4").tobytes()
        fresh = [w for w in {w for w, _ in words.values()} if w not in known]
        if fresh:
            # one text of words: each ends with a token that ends a word
            ids = np.array(self.tok.encode(" ".join(fresh), add_special_tokens=False).ids, "<u4")
            for w, part in zip(fresh, np.split(ids, np.flatnonzero(self.word_end[ids])[:-1] + 1)):
                known[w] = part.tobytes()
        for p, (word, tail) in words.items():
            known[p] = known[word] + known[tail]

    def placed(self, text: str, at: int = 0) -> np.ndarray:
        """Rows (id, start, end) of the tokens; places count from ``at``."""
        e = self.tok.encode(text, add_special_tokens=False)
        out = np.empty((len(e.ids), 3), np.int64)
        out[:, 0] = e.ids
        if len(e.ids):
            out[:, 1:] = np.array(e.offsets, np.int64) + at
        return out

    def decode(self, ids: bytes) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.plain_decode:
            return " ".join([self.pieces[i] for i in numbers])
        return self.tok.decode(numbers, skip_special_tokens=False)


def coder(spec: Broadcast | bytes) -> Coder:
    """The process's coder for a tokenizer file's content."""
    content = spec if isinstance(spec, bytes) else spec.value
    key = hash(content)
    if key not in _coders:
        _coders[key] = Coder(content)
    return _coders[key]


class Side(NamedTuple):
    """Tokens of a stretch of text: their ids, and if needed rows (id, start, end)."""

    ids: np.ndarray
    places: np.ndarray | None


def leaves(start: int, end: int, leaf_chars: int) -> list[tuple[int, int]]:
    """The spans that halving leads to."""
    if end - start <= leaf_chars:
        return [(start, end)]
    middle = (start + end) // 2
    return leaves(start, middle, leaf_chars) + leaves(middle, end, leaf_chars)


def _shared_run(a: np.ndarray, b: np.ndarray, last: bool) -> tuple[int, int] | None:
    """Places in ``a`` and ``b`` from which AGREE equal rows follow: the first such, or the last."""
    if len(a) < AGREE or len(b) < AGREE:
        return None
    starts = b[:, 1].tolist()
    order = range(len(a) - AGREE, -1, -1) if last else range(len(a) - AGREE + 1)
    for i in order:
        j = bisect_left(starts, a[i, 1])
        while j + AGREE <= len(b) and starts[j] == a[i, 1]:
            if np.array_equal(a[i : i + AGREE], b[j : j + AGREE]):
                return i, j
            j += 1
    return None


def _tail(c: Coder, text: str, side: Side, start: int, lo: int, middle: int) -> np.ndarray | None:
    """The placed tokens of text[start:middle] from ``lo`` on."""
    if side.places is not None:
        return side.places[np.searchsorted(side.places[:, 1], lo) :]
    # parts between blanks are encoded independently: from a blank on, the tail's tokens are those of the tail
    cut = lo if lo == start else min((i for i in (text.find(x, lo, middle) for x in BLANKS) if i >= 0), default=-1)
    return None if cut < 0 else c.placed(text[cut:middle], cut)


def _head(c: Coder, text: str, side: Side, middle: int, hi: int, end: int) -> np.ndarray | None:
    """The placed tokens of text[middle:end] that begin before ``hi``."""
    if side.places is not None:
        return side.places[: np.searchsorted(side.places[:, 1], hi)]
    cut = hi if hi == end else max(text.rfind(x, middle, hi) for x in BLANKS)
    return None if cut < 0 else c.placed(text[middle:cut], middle)


def join(c: Coder, text: str, left: Side, right: Side, start: int, middle: int, end: int) -> Side:
    """The tokens of text[start:end] from those of text[start:middle] and text[middle:end]."""
    reach = FIRST_WINDOW
    while True:
        lo, hi = max(start, middle - reach), min(end, middle + reach)
        window = c.placed(text[lo:hi], lo)
        tail, head = _tail(c, text, left, start, lo, middle), _head(c, text, right, middle, hi, end)
        cut_left = (0, 0) if lo == start else tail is not None and _shared_run(tail, window, last=False)
        cut_right = (0, len(window)) if hi == end else head is not None and _shared_run(head, window, last=True)
        if cut_left and cut_right and cut_left[1] <= cut_right[1]:
            kept_left = 0 if lo == start else len(left.ids) - len(tail) + cut_left[0]
            kept_right = len(right.ids) if hi == end else cut_right[0]
            between = window[cut_left[1] : cut_right[1]]
            ids = np.concatenate([left.ids[:kept_left], between[:, 0].astype("<u4"), right.ids[kept_right:]])
            places = None if left.places is None else np.concatenate([left.places[:kept_left], between, right.places[kept_right:]])
            return Side(ids, places)
        reach *= 2


def encode_leaf(c: Coder, text: str, start: int) -> Side:
    """A leaf's tokens; their places only where blanks can't tell them later."""
    if c.drops_space:
        return Side(np.frombuffer(c.encode(text), "<u4"), None)
    placed = c.placed(text, start)
    return Side(placed[:, 0].astype("<u4"), placed)


def meet(c: Coder, text: str, parts: list[Side], leaf_chars: int) -> Side:
    """Join the leaves' tokens up the tree of halves."""
    rest = iter(parts)

    def node(start: int, end: int) -> Side:
        if end - start <= leaf_chars:
            return next(rest)
        middle = (start + end) // 2
        left = node(start, middle)
        return join(c, text, left, node(middle, end), start, middle, end)

    return node(0, len(text))


def encode_tree(c: Coder, text: str, leaf_chars: int = LEAF_CHARS) -> bytes:
    """The ids of a text by tree concatenation, in one process."""
    parts = [encode_leaf(c, text[i:j], i) for i, j in leaves(0, len(text), leaf_chars)]
    return meet(c, text, parts, leaf_chars).ids.tobytes()


def _spec(docs: DataFrame, path: str) -> Broadcast:
    with open(path, "rb") as f:  # of the driver's installation; a vocabulary has a fixed size
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, *, leaf_chars: int = LEAF_CHARS, with_decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, token_ids) of each row; token_ids are little-endian unsigned 32-bit integers.

    ``with_decoded`` adds ``decoded``, what the ids decode to, as ``decode`` does in a pass of its own.

    ``path`` is a file of the tokenizers library.  Null and empty texts have no tokens.  Rows
    that repeat id and text come back as often as they came.  An empty table gives an empty
    result; other columns aren't carried.
    """
    small_batches(docs)
    spec = _spec(docs, path)
    rows = docs.select(F.col(id_col).alias("_cl_id"), text_of(text_col).alias("_cl_text"))
    kind = rows.schema["_cl_id"].dataType.simpleString()
    names = ["_cl_id", "n", "ids"] + ["decoded"] * with_decoded

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(spec)
        for batch in batches:
            ids = [c.encode(t) for t in batch.column("_cl_text").to_pylist()]
            decoded = [[c.decode(i) for i in ids]] if with_decoded else []
            columns = [batch.column("_cl_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), *[pa.array(d, pa.string()) for d in decoded]]
            yield pa.RecordBatch.from_arrays(columns, names)
        release()

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in range(batch.num_rows):
                text = batch.column("_cl_text")[one].as_py()
                spans = leaves(0, len(text), leaf_chars)
                take = pa.array([one] * len(spans))
                yield pa.RecordBatch.from_arrays([batch.column("_cl_row").take(take), pa.array([i for i, _ in spans], pa.int64()), pa.array([text[i:j] for i, j in spans], pa.string())], ["_cl_row", "start", "text"])

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(spec)
        for batch in batches:
            sides = [encode_leaf(c, t, s) for s, t in zip(batch.column("start").to_pylist(), batch.column("text").to_pylist())]
            places = [None if s.places is None else s.places.astype("<i8").tobytes() for s in sides]
            yield batch.append_column("ids", pa.array([s.ids.tobytes() for s in sides], pa.binary())).append_column("places", pa.array(places, pa.binary()))
        release()

    def meet_leaves(table: pa.Table) -> pa.Table:
        table = table.sort_by("start")
        texts, ids, places = (table.column(x).to_pylist() for x in ("text", "ids", "places"))
        parts = [Side(np.frombuffer(i, "<u4"), None if p is None else np.frombuffer(p, "<i8").reshape(-1, 3)) for i, p in zip(ids, places)]
        c = coder(spec)
        out = meet(c, "".join(texts), parts, leaf_chars).ids.tobytes()
        columns = [table.column("_cl_row").slice(0, 1), pa.array([len(out) // 4], pa.int64()), pa.array([out], pa.binary())]
        return pa.table([*columns, *([pa.array([c.decode(out)], pa.string())] if with_decoded else [])], names=["_cl_row", *names[1:]])

    rest = "n long, ids binary" + ", decoded string" * with_decoded
    short = rows.where(F.length("_cl_text") <= leaf_chars).mapInArrow(at_once, f"_cl_id {kind}, {rest}")
    # copies of a long text are coded once; each row gets the result by the text's digest
    long = rows.where(F.length("_cl_text") > leaf_chars).withColumn("_cl_row", F.md5("_cl_text"))
    texts = long.groupBy("_cl_row").agg(F.first("_cl_text").alias("_cl_text"))
    pieces = texts.mapInArrow(halve, "_cl_row string, start long, text string").repartition("_cl_row", "start")
    coded = pieces.mapInArrow(encode_leaves, "_cl_row string, start long, text string, ids binary, places binary")
    met = coded.groupBy("_cl_row").applyInArrow(meet_leaves, f"_cl_row string, {rest}")
    back = long.select("_cl_id", "_cl_row").join(met, "_cl_row").select(*names)
    return short.unionByName(back).select(F.col("_cl_id").alias(id_col), F.col("n").alias("n_tokens"), F.col("ids").alias("token_ids"), *["decoded"] * with_decoded)


def decode(tokens: DataFrame, path: str, *, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """Add ``out_col``, the text that the library decodes from the ids.  Null ids: empty."""
    small_batches(tokens)
    spec = _spec(tokens, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(spec)
        for batch in batches:
            texts = [c.decode(i or b"") for i in batch.column(ids_col).to_pylist()]
            yield batch.append_column(out_col, pa.array(texts, pa.string()))

    kept = tokens.drop(out_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, `{out_col}` string")
