"""Toxicity: a linear-chain CRF tags toxic spans, its marginals make document scores.

Documents, not tokens, are labelled.  Token labels come from the labelled documents of the
training fold: a word, or the beginning of a word, that stands in many different contexts in
toxic documents and in hardly any others marks its tokens there.  Counting contexts instead
of documents keeps the words of a much copied toxic document from looking toxic themselves.

The model is fitted in one task from a bounded sample (``max_docs`` labelled rows of each
class, ``max_pieces`` pieces of sentences); every document is scored, whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import fit_on_worker, release, small_batches, text_of

WORD = re.compile(r"[^\W_]+")
PREFIXES = (4, 5, 6)
#: Words of a sentence that are trained on together; contexts a mark needs, as a G statistic; frequent words that are features.
PIECE, EVIDENCE, FREQUENT = 60, 25.0, 2000
#: Tokens scored at a time, and token types that a worker remembers.
TOKENS, TYPES = 300_000, 400_000
THRESHOLD = 0.7
REST = 0  # the feature of all that wasn't learnt


@dataclass
class Model:
    """Feature numbers by name, and the fitted weights; small enough to send to every task."""

    features: dict[str, int]
    weights: np.ndarray
    trans: np.ndarray
    begin: np.ndarray
    scorer: np.ndarray  # bias, of the log odds that some token is toxic, of the log of their expected number


def keys_of(word: str) -> list[str]:
    return [word, *[f"{n}{word[:n]}" if len(word) > n else "" for n in PREFIXES]]


class Types:
    """Numbers for the distinct words that a worker has met, with their shares of the emission scores."""

    def __init__(self, model: Model):
        self.model, self.number = model, {}
        self.rows: list[list[int]] = []
        self.scored = np.zeros((0, 3, 2))

    def of(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        number = self.number
        try:
            return np.array([number[w] for w in words], np.int32)
        except KeyError:
            get = self.model.features.get
            for w in words:
                if w not in number:
                    number[w] = len(self.rows)
                    self.rows.append([get(k, REST) if k else REST for k in keys_of(w)])
            return np.array([number[w] for w in words], np.int32)

    def table(self) -> np.ndarray:
        """(type, own / as forerunner / as follower, tag) scores."""
        done = len(self.scored)
        if done < len(self.rows):
            rows, w = np.array(self.rows[done:], np.int64), self.model.weights
            n = len(w) // 3
            new = np.stack([w[rows].sum(axis=1), w[n + rows[:, :2]].sum(axis=1), w[2 * n + rows[:, :2]].sum(axis=1)], axis=1)
            self.scored = np.concatenate([self.scored, new])
        return self.scored


def emission(table: np.ndarray, types: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Own score of each token, and what its neighbours in the sequence add."""
    out = table[types, 0]
    ends = np.cumsum(lengths)
    last = np.zeros(len(types), bool)
    last[ends[lengths > 0] - 1] = True
    inner = np.flatnonzero(~last)
    out[inner + 1] += table[types[inner], 1]
    out[inner] += table[types[inner + 1], 2]
    return out


def document_inputs(marginal: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What the scorer sees of each document: 1, log odds of any toxic token, log of their expected number."""
    out = np.zeros((len(lengths), 3))
    out[:, 0] = 1
    full = np.flatnonzero(lengths > 0)
    starts = (np.cumsum(lengths) - lengths)[full]
    p = np.clip(marginal[:, 1], 1e-9, 1 - 1e-9)
    clean, number = np.full(len(lengths), -1e-6), np.zeros(len(lengths))
    if len(full):
        clean[full] = np.add.reduceat(np.log1p(-p), starts)
        number[full] = np.add.reduceat(p, starts)
    out[:, 1] = np.clip(np.log(-np.expm1(np.minimum(clean, -1e-6))) - clean, -12, 12)
    out[:, 2] = np.log1p(number)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a little ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = sigmoid(x @ w)
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(hess, x.T @ (y - p) - 1e-2 * w)
    return w


def find_marks(sentences: list[tuple[list[list[str]], int]]) -> tuple[set[str], set[str]]:
    """Words and word beginnings that mark toxic tokens, and the most frequent words.

    Each distinct (word, neighbours) of a class counts once.  A key is a mark if its contexts
    lie in toxic documents against the odds (likelihood ratio statistic) and eight times as
    densely as in the others.
    """
    number: dict[str, int] = {"": 0}
    found: tuple[list, list] = ([], [])
    for parts, y in sentences:
        for words in parts:
            if words:
                n = np.array([0, *[number.setdefault(w, len(number)) for w in words], 0], np.int64)
                found[y].append(np.stack([n[1:-1], n[:-2], n[2:]], axis=1))
    names = list(number)
    total, counts = [0, 0], [Counter(), Counter()]
    for y in (0, 1):
        own = np.unique(np.concatenate(found[y]), axis=0)[:, 0] if found[y] else np.zeros(0, np.int64)
        total[y] = len(own)
        for w, n in zip(*(x.tolist() for x in np.unique(own, return_counts=True))):
            counts[y][names[w]] = n
    if not all(total):
        return set(), set()
    keys: list[Counter] = [Counter(), Counter()]
    for y in (0, 1):
        for w, n in counts[y].items():
            for k in keys_of(w):
                if k:
                    keys[y][k] += n
    share = total[1] / sum(total)
    marks = set()
    for k, b in keys[1].items():
        a = keys[0][k]
        if b >= 3 and b / total[1] >= 8 * a / total[0]:
            n = a + b
            g = 2 * (b * np.log(b / (n * share)) + (a * np.log(a / (n * (1 - share))) if a else 0))
            if g >= EVIDENCE:
                marks.add(k)
    common = sorted(counts[0] | counts[1], key=lambda w: (-counts[0][w] - counts[1][w], w))
    return marks, set(common[:FREQUENT])


def fit(texts: list[str], toxic: list[int], *, max_pieces: int = 5000) -> Model:
    """A model from labelled documents.  Without documents of both classes all scores are the share of toxic ones."""
    share = float(np.mean(toxic)) if toxic else 0.0
    constant = Model({"": REST}, np.zeros((3, 2)), np.zeros((2, 2)), np.zeros(2), np.array([np.log((share + 1e-3) / (1 - share + 1e-3)), 0.0, 0.0]))
    if len(set(toxic)) < 2:
        return constant
    one: dict[str, str] = {}  # each distinct word is kept once
    sentences = [([[one.setdefault(w, w) for w in WORD.findall(s)] for s in t.lower().split("\n")], y) for t, y in zip(texts, toxic)]
    marks, frequent = find_marks(sentences)
    features = {"": REST} | {k: i + 1 for i, k in enumerate(sorted(marks | frequent))}
    pieces: tuple[list, list] = ([], [])
    for parts, y in sentences:
        for words in parts:
            for at in range(0, len(words), PIECE):
                piece = words[at : at + PIECE]
                tags = [int(y == 1 and not marks.isdisjoint(keys_of(w))) for w in piece]
                pieces[any(tags)].append((piece, tags))
    half = max_pieces // 2
    chosen = [x for own in pieces for x in own[:: max(1, -(-len(own) // half))]]
    size = len(features)
    rows, tags, lengths = [], [], []
    edge = np.full((1, 2), REST, np.int32)
    for words, own in chosen:
        ids = np.array([[features.get(k, REST) if k else REST for k in keys_of(w)] for w in words], np.int32)
        rows.append(np.hstack([ids, size + np.vstack([edge, ids[:-1, :2]]), 2 * size + np.vstack([ids[1:, :2], edge])]))
        tags += own
        lengths.append(len(words))
    weights, trans, begin = crf.train(np.concatenate(rows), np.array(tags, np.int64), np.array(lengths), 3 * size, 2)
    # the edge of a sequence has no neighbour, so those two features mean nothing
    weights[[size, 2 * size]] = 0
    model = Model(features, weights, trans, begin, np.zeros(3))
    x = np.concatenate([document_inputs(*marginals(model, Types(model), texts[i : i + 200])) for i in range(0, len(texts), 200)])
    model.scorer = _logistic(x, np.array(toxic, float))
    return model


def marginals(model: Model, types: Types, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all tokens of the texts, and the texts' token counts."""
    ids = [types.of(t) for t in texts]
    lengths = np.array([len(i) for i in ids], np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    marginal, _, _ = crf.forward_backward(emission(types.table(), flat, lengths), model.trans, model.begin, crf.Steps(lengths))
    return marginal, lengths


def spans_of(text: str, marginal: np.ndarray, floor: float = 0.5) -> list[tuple[int, int]]:
    """Spans of code points of the tokens at or over ``floor``; neighbouring tokens join."""
    out: list[tuple[int, int]] = []
    lower = text.lower()
    if len(lower) != len(text):  # a letter whose lower case is longer: places are those of single letters
        lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    before = False
    for p, m in zip(marginal, WORD.finditer(lower)):
        if p >= floor:
            if before:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append(m.span())
        before = p >= floor
    return out


def training_table(docs: DataFrame, labels: DataFrame, *, max_docs: int = 2000, max_chars: int = 50_000) -> DataFrame:
    """(_cl_order, _cl_id, _cl_row, _cl_toxic, _cl_text): texts and labels of at most ``max_docs`` rows of each class, of the fold crc32(doc_id) mod 3 <> 1.

    Rows of at most ``max_chars`` are chosen by a hash of their id.  The chosen keys, a bounded
    number, are broadcast.  Labels other than 0 and 1 and null ids are left out; rows that
    repeat id, text and label are one.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & fold).select(F.col("doc_id").alias("_cl_id"), F.col("toxic").alias("_cl_toxic")).distinct()
    texts = docs.select(F.col("doc_id").alias("_cl_id"), text_of("text").alias("_cl_text"))
    rows = texts.where(F.length("_cl_text") <= max_chars).withColumn("_cl_row", F.xxhash64("_cl_text"))
    key = ["_cl_order", "_cl_id", "_cl_row"]
    light = rows.select("_cl_id", "_cl_row").join(known, "_cl_id").withColumn("_cl_order", F.xxhash64("_cl_id")).distinct()
    pick = [light.where(F.col("_cl_toxic") == y).orderBy(*key).limit(max_docs) for y in (0, 1)]
    chosen = F.broadcast(pick[0].unionByName(pick[1]))
    return rows.join(chosen, ["_cl_id", "_cl_row"]).groupBy(*key, "_cl_toxic").agg(F.first("_cl_text").alias("_cl_text"))


def fit_rows(rows: list[dict]) -> Model:
    """``fit`` of rows of ``training_table``, in whatever order they come."""
    ordered = sorted(rows, key=lambda r: (r["_cl_order"], r["_cl_id"], r["_cl_toxic"], r["_cl_row"]))
    return fit([r["_cl_text"] for r in ordered], [int(r["_cl_toxic"]) for r in ordered])


def trained(docs: DataFrame, labels: DataFrame, **bounds) -> Model:
    """The model of the labelled documents of the training fold, fitted in one task."""
    return fit_on_worker(training_table(docs, labels, **bounds), fit_rows)


def score_texts(types: Types, texts: list[str], with_spans: bool = False) -> tuple[np.ndarray, list]:
    """Scores of the texts, and their spans if asked for.  Texts of like length go in step."""
    m = types.model
    if len(types.rows) > TYPES:
        types.__init__(m)
    ids = [types.of(t) for t in texts]
    lengths = np.array([len(i) for i in ids], np.int64)
    order = np.argsort(lengths, kind="stable")
    group = np.cumsum(lengths[order]) // TOKENS
    scores, spans = np.zeros(len(texts)), [None] * len(texts)
    for g in np.unique(group):
        own = order[group == g]
        p, _, _ = crf.forward_backward(emission(types.table(), np.concatenate([ids[i] for i in own]), lengths[own]), m.trans, m.begin, crf.Steps(lengths[own]))
        scores[own] = sigmoid(document_inputs(p, lengths[own]) @ m.scorer)
        if with_spans:
            for i, e in zip(own, np.cumsum(lengths[own])):
                q = p[e - lengths[i] : e, 1]
                spans[i] = [{"start": a, "end": b} for a, b in spans_of(texts[i], q)] if (q >= 0.5).any() else []
    return np.round(scores, 9), spans


def score(docs: DataFrame, model: Model, *, with_spans: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_cl_id, _cl_row, score, spans) of each row; _cl_row is a hash of the text.

    ``spans`` lists start and end of toxic spans in code points (null unless ``with_spans``).
    Null and empty texts have no tokens; they get the scorer's bias.  Equal texts get scores
    that agree to nine digits, whatever else is scored with them.  Repeated rows are scored
    each; an empty table gives an empty result.  No other columns are carried, so none can clash.
    """
    small_batches(docs)
    rows = docs.select(F.col(id_col).alias("_cl_id"), F.xxhash64(text_of(text_col)).alias("_cl_row"), text_of(text_col).alias("_cl_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = Types(shared.value)
        for batch in batches:
            scores, spans = score_texts(types, batch.column("_cl_text").to_pylist(), with_spans)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("_cl_id"), batch.column("_cl_row"), pa.array(scores), pa.array(spans, kind)], ["_cl_id", "_cl_row", "score", "spans"])

    id_type = rows.schema["_cl_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_cl_id {id_type}, _cl_row long, score double, spans array<struct<start: long, end: long>>")


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def reject_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; the same columns, whatever their names.

    Null and empty texts score as texts without tokens.  Without labels of both classes nothing
    can be learnt; then only a ``threshold`` under the share of toxic labels rejects.  An empty
    table gives an empty result.
    """
    small_batches(docs)
    model = trained(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = Types(shared.value)
        for batch in batches:
            scores, _ = score_texts(types, [t or "" for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(scores < threshold))
        del types
        release()

    return docs.mapInArrow(run, docs.schema)
