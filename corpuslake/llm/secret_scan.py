"""Secret scans: exact patterns, and a linear-chain CRF that finds what they miss.

The CRF tags tokens as the begin or the inside of a secret or as outside of any, from the
token's shape, the words next to it and features of the whole file, and is decoded by
Viterbi.  It is fitted in one task from a bounded sample of documents: their base spans
are labels, and secrets made up by rule are put into copies of them, with labels that are
known exactly.  As many look-alikes that aren't secrets (long words, card, phone and account
numbers, addresses, dates, paths) are put in too.  What is reported is set by the precision
on made-up secrets and look-alikes that were held out of the fit.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import fit_on_worker, small_batches, text_of

# fixed values: the base patterns, in the order in which kinds are listed
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")

TOKEN = re.compile(r"[A-Za-z0-9+/_-]+|[^\sA-Za-z0-9+/_-]")
WORD = re.compile(r"[A-Za-z0-9+/_-](?:.*[A-Za-z0-9+/_-])?", re.DOTALL)
OUT, BEGIN, INSIDE = 0, 1, 2
TOKENS, TYPES = 250_000, 300_000
#: A fifth of the pieces is held out; spans have to win by the least of MARGINS that gives this precision there.
HELD_OUT, PRECISION, MARGINS = 5, 0.98, np.arange(0.0, 6.5, 0.5)
#: Made-up secrets, and as many look-alikes, that are put in at least, however few the texts are.
PLANTS = 2000
HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "cred", "bearer", "private", "login")
FILE_CLASSES = 4
#: Shorter spans of the CRF aren't reported; the base patterns take values from this length on.
MIN_CHARS = 6


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base matches, by start, then kind.

    Words that every match of a pattern contains are looked for first, which is much faster.
    """
    out = []
    low = text.lower()  # longer for some letters, but the words are ASCII
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


#: What is seen of a token; where else than at the token itself the same is seen; how many tokens before it a name may stand.
SHAPES, NEAR, REACH = 5, (-1, -2, 1), 4
#: A token's own features count apart for each of these: no name before it, a name just before it, a name and a sign.
PLAIN, NAMED, ASSIGNED = 0, 1, 2
CONTEXTS = 3
PARTS = CONTEXTS + len(NEAR)


def letter_pairs(words: list[str]) -> dict[str, float]:
    """Log probabilities (base 2) of a character after another in words, digits as one; "" has that of pairs not met."""
    pairs, first = Counter(), Counter()
    for w in words:
        w = DIGIT.sub("0", w.lower())
        pairs.update(map("".join, zip(w, w[1:])))
        first.update(w[:-1])
    return {p: math.log2((n + 0.1) / (first[p[0]] + 4)) for p, n in pairs.items()} | {"": -10.0}


DIGIT = re.compile(r"[0-9]")


def shape_keys(token: str, pairs: dict[str, float]) -> list[str]:
    """What is seen of a token: its class, its length, how evenly its characters are spread, hints in it, how word-like it is."""
    n = len(token)
    if n == 1:
        return [f"c{token}" if token.isascii() else "c?", "", "", "", ""]
    low = token.lower()
    digits = sum(c.isdigit() for c in token)
    if not any(c.isalpha() for c in token):
        kind = "d" if digits == n else "s"
    else:
        kind = ("D" if digits * 4 >= n else "e" if digits else "") + ("u" if token.isupper() else "l" if token.islower() else "t" if token[1:].islower() else "m")
    counts = Counter(token).values()
    spread = -sum(c / n * math.log2(c / n) for c in counts)
    hint = next((h for h in HINTS if h in low), "")
    bare = DIGIT.sub("0", low)
    rare = pairs.get("", -10.0)
    usual = sum(pairs.get(x, rare) for x in map("".join, zip(bare, bare[1:]))) / (n - 1)
    return [f"k{kind}", f"n{min(n, 12) if n < 12 else 12 + (n >= 16) + (n >= 24) + (n >= 40)}", f"e{int(spread * 2)}{kind}", f"h{hint}" if hint else "", f"w{int(usual)}{kind}{min(n, 16) // 4}"]


def file_class(text: str) -> int:
    """A class of the whole text: whether it has many signs of code, and many digits."""
    n = len(text) or 1
    signs = sum(map(text.count, "=:{}\"'"))
    digits = sum(map(text.count, "0123456789"))
    return 2 * (signs * 50 > n) + (digits * 50 > n)


@dataclass
class Model:
    features: dict[str, int]
    pairs: dict[str, float]
    weights: np.ndarray  # own by context, then by place: each as many rows as features; then the file classes
    trans: np.ndarray
    begin: np.ndarray
    precision: float = 0.0  # on what was held out, by spans
    recall: float = 0.0


class Types:
    """Distinct tokens that a worker has met, with their shares of the emission scores."""

    def __init__(self, model: Model):
        self.model, self.number = model, {}
        self.rows: list[list[int]] = []
        self.marks: list[int] = []
        self.scored = np.zeros((0, PARTS, 3))

    def add(self, word: str) -> int:
        """The number of a token, a new one if it wasn't met."""
        if word not in self.number:
            get = self.model.features.get
            self.number[word] = len(self.rows)
            self.rows.append([get(k, 0) for k in shape_keys(word, self.model.pairs)])
            self.marks.append(mark_of(word))
        return self.number[word]

    def of(self, text: str) -> np.ndarray:
        tokens = TOKEN.findall(text)
        number = self.number
        try:
            return np.array([number[w] for w in tokens], np.int32)
        except KeyError:
            return np.array([self.add(w) for w in tokens], np.int32)

    def table(self) -> np.ndarray:
        done = len(self.scored)
        if done < len(self.rows):
            rows, size = np.array(self.rows[done:], np.int64), len(self.model.features)
            new = np.stack([self.model.weights[part * size + rows].sum(axis=1) for part in range(PARTS)], axis=1)
            self.scored = np.concatenate([self.scored, new])
        return self.scored


def mark_of(token: str) -> int:
    """1 for a token with a hint, 2 for a sign that assigns, else 0."""
    low = token.lower()
    return 2 if token in ":=" else 1 if any(h in low for h in HINTS) else 0


def context(marks: np.ndarray, sequence: np.ndarray) -> np.ndarray:
    """Of each token whether a hint stands just before it (NAMED) or within REACH with a sign behind the hint (ASSIGNED)."""
    out = np.zeros(len(marks), np.int8)
    for hint in np.flatnonzero(marks == 1).tolist():
        signs = 0
        for i in range(hint + 1, min(hint + 1 + REACH, len(marks))):
            if sequence[i] != sequence[hint]:
                break
            out[i] = max(out[i], ASSIGNED if signs else NAMED if i <= hint + 2 else PLAIN)
            signs += marks[i] == 2
    return out


def emission(types: Types, flat: np.ndarray, lengths: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Scores of the tags of all tokens of sequences, one after another."""
    table = types.table()
    out = np.repeat(types.model.weights[PARTS * len(types.model.features) + classes], lengths, axis=0)
    sequence = np.repeat(np.arange(len(lengths)), lengths)
    out += table[flat, context(np.array(types.marks, np.int8)[flat], sequence)]
    for part, place in enumerate(NEAR):
        gap = abs(place)
        same = np.flatnonzero(sequence[gap:] == sequence[:-gap])
        here, there = (same + gap, same) if place < 0 else (same, same + gap)
        out[here] += table[flat[there], CONTEXTS + part]
    return out


def sure_slack(model: Model) -> np.ndarray:
    """By how much OUT must beat each other tag at a token to be its best tag whatever its neighbours' tags are."""
    trans, begin = model.trans, model.begin
    before = np.maximum((trans - trans[:, [OUT]]).max(axis=0), begin - begin[OUT])
    after = np.maximum((trans - trans[[OUT], :]).max(axis=1), 0)
    return (before + after)[1:]


def tag_flat(types: Types, flat: np.ndarray, lengths: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The tags of Viterbi for sequences one after another.

    A token where OUT leads by more than ``sure_slack`` is OUT in the best path, since tagging it
    otherwise could win less through its neighbours.  Such tokens, nearly all, cut the
    sequences; only the runs between them are decoded, beginning and ending next to an OUT.
    """
    model = types.model
    emit = emission(types, flat, lengths, classes)
    tags = np.zeros(len(flat), np.int8)
    unsure = (emit[:, [OUT]] - emit[:, 1:] <= sure_slack(model)).any(axis=1)
    if not unsure.any():
        return tags
    sequence = np.repeat(np.arange(len(lengths)), lengths)
    first = np.concatenate([[True], sequence[1:] != sequence[:-1]])
    last = np.concatenate([first[1:], [True]])
    at = np.flatnonzero(unsure)
    opens = first[at] | ~unsure[at - 1]
    closes = last[at] | ~unsure[np.minimum(at + 1, len(flat) - 1)]
    own = emit[at]
    own[opens] += np.where(first[at[opens]][:, None], model.begin, model.trans[OUT])
    inner = closes & ~last[at]
    own[inner] += model.trans[:, OUT]
    runs = np.diff(np.append(np.flatnonzero(opens), len(at)))
    tags[at] = crf.viterbi(own, model.trans, np.zeros(3), crf.Steps(runs))
    return tags


def tag_texts(types: Types, texts: list[str]) -> list[list[tuple[int, int]]]:
    """Spans of secrets that Viterbi finds in each text."""
    if len(types.rows) > TYPES:
        types.__init__(types.model)
    ids = [types.of(t) for t in texts]
    lengths = np.array([len(i) for i in ids], np.int64)
    group = np.cumsum(lengths) // TOKENS
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for g in np.unique(group):
        own = np.flatnonzero(group == g)
        classes = np.array([file_class(texts[i]) for i in own])
        tags = tag_flat(types, np.concatenate([ids[i] for i in own]), lengths[own], classes)
        ends = np.cumsum(lengths[own])
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(tags), side="right")):
            i = own[k]
            out[i] = [s for s in _spans(texts[i], tags[ends[k] - lengths[i] : ends[k]]) if s[1] - s[0] >= MIN_CHARS]
    return out


def _spans(text: str, tags: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    before = OUT
    for tag, m in zip(tags.tolist(), TOKEN.finditer(text)):
        if tag == BEGIN or tag == INSIDE and before == OUT:
            out.append(m.span())
        elif tag == INSIDE:
            out[-1] = (out[-1][0], m.end())
        before = tag
    return out


def outside(text: str, span: tuple[int, int], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of a span that no base span covers, without blanks and marks around them."""
    parts, at = [], span[0]
    for a, b, _ in [*base, (span[1], span[1], 0)]:
        if a >= at:
            parts.append((at, min(a, span[1])))
        at = max(at, b)
        if at >= span[1]:
            break
    return [(a + m.start(), a + m.end()) for a, b in parts if (m := WORD.search(text[a:b]))]


UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = ("abcdef" + DIGITS, UPPER + "234567", UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/_-")
NAMES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "auth", "auth_token", "credential", "private_key", "access_key", "login_key")
#: What stands before look-alikes.
LABELS = ("", "", "", "card ", "card: ", "phone ", "tel: ", "account: ", "id=", "ref: ", "order ", "no. ", "see ", "mail: ", "from ", "ip=", "value = ", "code: ", "date: ")


def made_up(rng: random.Random) -> tuple[str, str, str]:
    """What stands before a made-up secret, the secret, and what stands behind.

    A secret mixes letters and digits, unless a name and a sign assign it; one without a name or
    mark before it is long.
    """
    name = rng.choice(NAMES)
    name = rng.choice((name, name.upper(), name.title()))
    quote = rng.choice(("", "", '"', "'"))
    lead = rng.choice((f"{name}={quote}", f"{name}: {quote}", f"{name} = {quote}", f'"{name}": "', "Bearer ", f"{name} ", ""))
    mark = rng.choice(("", "", "", "AKIA", "ghp_", "sk-", "xoxb-"))
    alphabet = rng.choice(ALPHABETS if lead or mark else ALPHABETS[2:])
    size = rng.randint(6 if lead else 16, 44)
    assigned = "=" in lead or ":" in lead
    body = ""
    while not (any(c.isalpha() for c in body) and (assigned or any(c.isdigit() for c in body))):
        body = "".join(rng.choice(alphabet) for _ in range(size))
    tail = '"' if lead.endswith('"') else "'" if lead.endswith("'") else ""
    return lead, mark + body, tail


def look_alike(rng: random.Random, words: list[str]) -> str:
    """Something with its label that might be taken for a secret but is none; ``words`` are the text's own."""
    digits = lambda n: "".join(rng.choice(DIGITS) for _ in range(n))
    some = lambda: rng.choice(words or ["word"])
    joined = "".join(some() for _ in range(rng.randint(2, 4)))
    kind = rng.randrange(12)
    if kind < 3:
        value = rng.choice((joined.lower(), joined.upper(), joined.title(), some() + some().title() + some().title()))
    elif kind < 6:
        sep = rng.choice(("", "", " ", "-"))
        value = rng.choice((sep.join(digits(4) for _ in range(4)), digits(rng.randint(5, 20)), f"+{digits(rng.randint(1, 2))} ({digits(3)}) {digits(3)}-{digits(4)}"))
    elif kind == 6:
        value = rng.choice((".".join(str(rng.randrange(256)) for _ in range(4)), f"{rng.randint(1900, 2099)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}"))
    elif kind == 7:
        value = rng.choice((f"{some()}.{digits(2)}@{some()}{digits(1)}.example.com", f"https://{some()}.example.com/{some()}/{digits(rng.randint(1, 6))}", f"/{some()}/{some()}_{digits(3)}.txt"))
    elif kind == 8:
        value = rng.choice(("DE", "FR", "ES", "GB")) + digits(2) + rng.choice((digits(18), " ".join(digits(4) for _ in range(4))))
    elif kind == 9:
        value = rng.choice((f"{some()}_{some()}", f"{some()}-{some()}-{digits(2)}", f"v{digits(1)}.{digits(2)}", f"{some()}{digits(rng.randint(1, 4))}", f"{digits(4)}{some()}"))
    else:
        return rng.choice((f"{rng.choice(NAMES)} {some()}", f"the {rng.choice(NAMES)} of {some()}", f"{rng.choice(NAMES)}, {some()} {some()}"))
    return rng.choice(LABELS) + value


def _labelled(text: str, spans: list[tuple[int, int]]) -> tuple[list[str], list[int]]:
    tokens, tags, k = [], [], 0
    opened = -1
    for m in TOKEN.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        inside = k < len(spans) and spans[k][0] <= m.start()
        tokens.append(m.group())
        tags.append(OUT if not inside else INSIDE if opened == k else BEGIN)
        opened = k if inside else opened
    return tokens, tags


def _values(text: str) -> list[tuple[int, int]]:
    """The secrets themselves within the base matches: of an assignment its value."""
    spans = [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    spans += [m.span() for p in (ACCESS, HEX) for m in p.finditer(text) if m.end() - m.start() >= 20]
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def planted(rng: random.Random, words: list[str], what: tuple[str, str, str]) -> tuple[str, list[tuple[int, int]]]:
    """A text of ``words`` with something put in, and the spans of all secrets in it; ``what`` is (before, secret, behind)."""
    lead, secret, tail = what
    cut = rng.randint(0, len(words))
    before = " ".join([*words[:cut], lead])
    made = f"{before}{secret}{tail} {' '.join(words[cut:])}"
    own = [(len(before), len(before) + len(secret))] if secret else []
    others = [s for s in _values(made) if not own or s[1] <= own[0][0] or s[0] >= own[0][1]]
    return made, sorted([*others, *own])


def training_pieces(texts: list[str], *, piece: int = 60, max_pieces: int = 6000, seed: int = 7) -> list[tuple[list[str], list[int], int]]:
    """(tokens, tags, file class) of pieces of the texts, with made-up secrets and look-alikes put into copies of some."""
    rng = random.Random(seed)
    pieces: list[tuple[list[str], list[int], int]] = []
    for text in texts or [""]:
        tokens, tags = _labelled(text, _values(text))
        kind = file_class(text)
        starts = list(range(0, len(tokens), piece))
        secret = [i for i in starts if any(tags[i : i + piece])]
        # beside pieces with secrets some with digits or long words, which are most easily taken for secrets, and any
        hard = [i for i in starts if any(len(w) >= 12 or not w.isalpha() for w in tokens[i : i + piece] if len(w) > 1)]
        chosen = rng.sample(secret, min(2, len(secret))) + rng.sample(hard, min(2, len(hard))) + rng.sample(starts, min(1, len(starts)))
        pieces += [(tokens[i : i + piece], tags[i : i + piece], kind) for i in chosen]
        words = tokens[chosen[-1] : chosen[-1] + piece] if chosen else []
        letters = [w for w in words if w.isalpha() and len(w) > 1]
        for _ in range(max(2, PLANTS // max(len(texts), 1))):
            for what in (made_up(rng), (look_alike(rng, letters), "", "")):
                pieces.append((*_labelled(*planted(rng, words, what)), kind))
    pieces = rng.sample(pieces, min(max_pieces, len(pieces)))
    return [p for p in pieces if p[0]]


def _runs(tags: np.ndarray, lengths: np.ndarray, chars: np.ndarray) -> set[tuple[int, int]]:
    """Spans of tokens, as (first, end), of tags of sequences one after another; those under MIN_CHARS aren't reported."""
    out, at = set(), 0
    for n in lengths.tolist():
        start = None
        for i in range(at, at + n):
            if start is not None and tags[i] != INSIDE:
                out.add((start, i))
                start = None
            if start is None and tags[i] != OUT:
                start = i
        if start is not None:
            out.add((start, at + n))
        at += n
    return {(a, b) for a, b in out if chars[a:b].sum() >= MIN_CHARS}


def fit(texts: list[str], **options) -> Model:
    """A model from sample texts, made-up secrets and look-alikes.  Deterministic for the same texts in the same order."""
    pieces = training_pieces(texts, **options)
    held = [p for i, p in enumerate(pieces) if i % HELD_OUT == 0]
    used = [p for i, p in enumerate(pieces) if i % HELD_OUT]
    pairs = letter_pairs([w for tokens, own, _ in used for w, t in zip(tokens, own) if t == OUT and w.isalpha()])
    names = sorted({k for tokens, _, _ in used for w in set(tokens) for k in shape_keys(w, pairs)} | {""})
    features = {k: i for i, k in enumerate(names)}
    size = len(features)
    nothing = np.full((2, SHAPES), features[""], np.int32)
    rows, tags, lengths = [], [], []
    for tokens, own, kind in used:
        ids = np.array([[features[k] for k in shape_keys(w, pairs)] for w in tokens], np.int32)
        placed = context(np.array([mark_of(w) for w in tokens], np.int8), np.zeros(len(tokens), np.int8)).astype(np.int32)
        around = [np.vstack([nothing[: min(-place, len(ids))], ids[: max(0, len(ids) + place)]] if place < 0 else [ids[place:], nothing[:place]]) for place in NEAR]
        rows.append(np.hstack([placed[:, None] * size + ids, *[(CONTEXTS + p) * size + other for p, other in enumerate(around)], np.full((len(ids), 1), PARTS * size + kind, np.int32)]))
        tags += own
        lengths.append(len(tokens))
    columns = SHAPES * (1 + len(NEAR)) + 1
    weights, trans, begin = crf.train(np.concatenate([np.zeros((0, columns), np.int32), *rows]), np.array(tags, np.int64), np.array(lengths, np.int64), PARTS * size + FILE_CLASSES, 3, rounds=120, l2=1e-6)
    weights[[part * size + features[""] for part in range(PARTS)]] = 0
    return _decided(Model(features, pairs, weights, trans, begin), held)


def _decided(model: Model, held: list[tuple[list[str], list[int], int]]) -> Model:
    """The model with the least margin that OUT gets over the other tags for the wanted precision on ``held``; else the most precise."""
    lengths = np.array([len(tokens) for tokens, _, _ in held], np.int64)
    chars = np.array([len(w) for tokens, _, _ in held for w in tokens], np.int64)
    gold = _runs(np.array([t for _, own, _ in held for t in own], np.int8), lengths, chars)
    classes, weights, best = np.array([kind for _, _, kind in held], np.int64), model.weights, None
    for margin in MARGINS:
        tried = Model(model.features, model.pairs, weights.copy(), model.trans, model.begin)
        tried.weights[PARTS * len(model.features) :, OUT] += margin
        types = Types(tried)
        flat = np.array([types.add(w) for tokens, _, _ in held for w in tokens], np.int64)
        found = _runs(tag_flat(types, flat, lengths, classes), lengths, chars) if len(flat) else set()
        tried.precision, tried.recall = len(found & gold) / max(len(found), 1), len(found & gold) / max(len(gold), 1)
        if best is None or tried.precision > best.precision:
            best = tried
        if tried.precision >= PRECISION:
            break
    return best


def training_table(docs: DataFrame, *, max_docs: int = 1000, max_chars: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_cl_order, _cl_id, _cl_row, _cl_text): at most ``max_docs`` different texts of at most ``max_chars``, chosen by a hash of their ids; the chosen keys are broadcast.

    Rows without an id are no samples; rows that repeat id and text are one.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.xxhash64(F.col(id_col)).alias("_cl_order"), F.col(id_col).alias("_cl_id"), text_of(text_col).alias("_cl_text"))
    rows = rows.where(F.length("_cl_text") <= max_chars).withColumn("_cl_row", F.xxhash64("_cl_text"))
    key = ["_cl_order", "_cl_id", "_cl_row"]
    chosen = rows.select(*key).distinct().orderBy(*key).limit(max_docs)
    return rows.join(F.broadcast(chosen), key).groupBy(*key).agg(F.first("_cl_text").alias("_cl_text"))


def fit_rows(rows: list[dict]) -> Model:
    """``fit`` of rows of ``training_table``, in whatever order they come."""
    return fit([r["_cl_text"] for r in sorted(rows, key=lambda r: (r["_cl_order"], r["_cl_id"], r["_cl_row"]))])


def trained(docs: DataFrame, **options) -> Model:
    """The model of a sample of the documents, fitted in one task."""
    return fit_on_worker(training_table(docs, **options), fit_rows)


def scan(docs: DataFrame, model: Model | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans) of each row: spans have start, end (code points, end exclusive) and kind, by start, then kind.

    Base spans are all kept; of the CRF's spans the parts outside them are added, if they have
    MIN_CHARS.  Null and empty texts have no spans.  Rows that repeat an id are scanned each;
    an empty table gives an empty result.  No other columns are carried, so none can clash.
    """
    model = model or trained(docs, id_col=id_col, text_col=text_col)
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = Types(shared.value)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = []
            for text, more in zip(texts, tag_texts(types, texts)):
                spans = base_spans(text)
                own = list(spans)
                spans += [(a, b, 3) for s in more for a, b in outside(text, s, own) if b - a >= MIN_CHARS]
                spans.sort(key=lambda s: (s[0], s[2]))
                out.append([{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, kind)], ["id", "spans"])

    id_type = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(run, f"id {id_type}, spans array<struct<start: long, end: long, kind: string>>").withColumnRenamed("id", id_col)
