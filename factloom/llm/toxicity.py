"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A character trigram model is counted from all documents.  Where a text has
leetspeak inside a word, letters spaced out, or a letter three times running,
a lattice of the readings of that stretch (symbol -> letter, separator
dropped, repetition dropped, each with a channel cost) is decoded by Viterbi
under the model; everywhere else the lattice has one path, the text itself.

The restored words are scored by what the labels teach: whole words (repeated
letters squeezed) and word prefixes whose share of toxic documents is
significantly high.  A document's score is that of its most telling word.
The scorer is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm._features import dense, gather_counts, pieces
from factloom.llm._text import SpanHasher, append_columns, map_batches, runs
from factloom.llm.durable import durable
from factloom.llm.quality_classifier import remainder, sampled, training_texts

#: Most labelled rows that the scorer is fitted on.
SAMPLE_ROWS = 6000
PREFIXES = (4, 5, 6, 7, 8)
#: Letters: 0 other, 1-26 a-z, 27-58 the second bytes of Latin-1 letters.
_LETTERS = 59
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c"}
SEPARATORS = " .-_*"
LEET_COST, BREAK_COST, GAP_COST, KEEP_COST, REPEAT_COST = 1.0, 7.0, 0.3, 2.5, 0.2

_is_letter = np.zeros(256, bool)
_is_letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_is_leet = np.zeros(256, bool)
_is_leet[[ord(c) for c in LEET if ord(c) < 128]] = True
_is_gap = np.zeros(256, bool)
_is_gap[[ord(c) for c in SEPARATORS]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)

_W = r"[^\W\d_]"
_L = "".join(re.escape(c) for c in LEET)
_SPACED = re.compile(rf"(?<!\w)(?:{_W}|[{_L}])(?:([ .\-_*])(?:{_W}|[{_L}]))(?:\1(?:{_W}|[{_L}])){{1,}}(?!\w)")
_TOKEN = re.compile(r"\S+")
_ODD_TOKEN = re.compile(rf"{_W}[{_L}]+{_W}|(?<!\w)[{_L}]+{_W}|{_W}{{2}}[0-9@$](?!\w)|({_W})\1\1", re.IGNORECASE)


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8 bytes, byte for byte."""
    out = _LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    out[second] += 32
    return out


def _codes(text: str) -> list[int]:
    out = []
    for c in text:
        o = ord(c)
        out.append(o - 96 if 97 <= o <= 122 else 27 + (o & 31) if 0xC0 <= o <= 0xFF else 0)
    return out


def _trigrams(batch: pa.RecordBatch) -> list[np.ndarray]:
    total = np.zeros(_LETTERS**3, np.int64)
    for _, _, data, offs in pieces(batch.column("text")):
        code = _CODE[_LOWER[data]]
        lead = data == 0xC3
        second = np.flatnonzero(lead[:-1]) + 1
        code[second] = 27 + (data[second] & 31)
        code[offs[1:-1][offs[1:-1] < len(data)]] = 0
        code = code[~lead]
        total += np.bincount(code[:-2] * _LETTERS**2 + code[1:-1] * _LETTERS + code[2:], minlength=_LETTERS**3)
    return [total]


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Negative log probabilities [before last, last, next] from all documents."""
    counts = gather_counts(docs, {"text": F.col(text_col).cast("string")}, _trigrams, ["n"])
    n = dense(counts, ["n"], _LETTERS**3)[0].reshape(_LETTERS, _LETTERS, _LETTERS).astype(np.float64)
    pair = n.sum(0) + 0.05
    pair /= pair.sum(1, keepdims=True)
    return -np.log((n + 2 * pair[None]) / (n.sum(2, keepdims=True) + 2)).astype(np.float32)


class Restorer:
    """Viterbi decoder of the readings of a stretch of text."""

    def __init__(self, costs: np.ndarray) -> None:
        self.costs = costs.tolist()
        self.known: dict[str, str] = {}

    def _readings(self, s: str, i: int, spaced: bool) -> list[tuple[str, float]]:
        """(what is written out, channel cost) of character ``i``; '' drops it."""
        c = s[i]
        if c in LEET:
            return [*((letter, LEET_COST) for letter in LEET[c]), (c, BREAK_COST)]
        if spaced and c in SEPARATORS and 0 < i < len(s) - 1:
            return [("", GAP_COST), (c, KEEP_COST)]
        if i >= 1 and s[i - 1] == c and c.isalpha():
            run = i
            while run and s[run - 1] == c:
                run -= 1
            long = i - run >= 2 or s[i : i + 2] == c * 2 or s[run : run + 3] == c * 3
            return [("", REPEAT_COST), (c, 0.0 if i - run < 2 else BREAK_COST)] if long else [(c, 0.0)]
        return [(c, 0.0)]

    def decode(self, stretch: str, spaced: bool = False) -> str:
        s = stretch.lower()
        if (done := self.known.get(s)) is not None:
            return done
        costs = self.costs
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for i in range(len(s)):
            nxt: dict[tuple[int, int], tuple[float, tuple]] = {}
            for out, channel in self._readings(s, i, spaced):
                code = _codes(out)[0] if out else -1
                for (a, b), (cost, path) in best.items():
                    if code < 0:
                        state, total, way = (a, b), cost + channel, path
                    else:
                        state, total, way = (b, code), cost + channel + costs[a][b][code], (path, out)
                    if state not in nxt or total < nxt[state][0]:
                        nxt[state] = (total, way)
            best = nxt
        _, path = min((cost + costs[a][b][0], path) for (a, b), (cost, path) in best.items())
        out = []
        while path:
            path, c = path
            out.append(c)
        if len(self.known) > 50_000:
            self.known.clear()
        self.known[s] = text = "".join(reversed(out))
        return text

    def _token(self, m: re.Match) -> str:
        token = m[0]
        if not _ODD_TOKEN.search(token):
            return token
        body = token.strip(".,;:?\"'#*%&)")
        body = body if not (tail := re.search(r"[!$|+@(]{2,}$", body)) else body[: tail.start()]
        return token.replace(body, self.decode(body), 1) if body else token

    def restore(self, text: str) -> str:
        text = _SPACED.sub(lambda m: self.decode(m[0], True), text)
        return _TOKEN.sub(self._token, text)


def suspicious(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows whose lattice may have more than one path (a superset)."""
    n = len(data)
    if not n:
        return np.zeros(len(offs) - 1, bool)
    hit = np.zeros(n, bool)
    first, last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    first[offs] = True
    last[:-1] = first[1:]
    first, last = first[:n], last[:n]
    a, leet, gap, low = _is_letter[data], _is_leet[data], _is_gap[data], _LOWER[data]
    digit = leet & (data < 65) & (data != 33)
    hit[:-1] |= leet[:-1] & a[1:]
    hit[1:] |= digit[1:] & a[:-1]
    hit[1:-1] |= a[1:-1] & (low[1:-1] == low[2:]) & (low[1:-1] == low[:-2])
    one = a | leet
    alone = one.copy()
    alone[1:] &= ~one[:-1] | first[1:]
    alone[:-1] &= ~one[1:] | last[:-1]
    hit[: max(0, n - 4)] |= alone[:-4] & gap[1:-3] & alone[2:-2] & gap[3:-1] & alone[4:]
    # letters of two bytes that stand alone, or repeat
    w = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] <= 0xDF)) if n > 1 else np.zeros(0, np.int64)
    before, after = np.concatenate([[True], gap])[w] | first[w], np.concatenate([gap, [True, True]])[w + 2] | last[w + 1]
    hit[w[before & after]] = True
    w = w[w + 5 < n]
    hit[w[(data[w] == data[w + 2]) & (data[w + 1] == data[w + 3]) & (data[w] == data[w + 4]) & (data[w + 1] == data[w + 5])]] = True
    # the euro sign, the one leet symbol of three bytes, wherever it stands
    hit[:-2] |= (data[:-2] == 0xE2) & (data[1:-1] == 0x82) & (data[2:] == 0xAC)
    edge = np.concatenate([[0], np.cumsum(hit)])
    return edge[offs[1:]] > edge[offs[:-1]]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), offs


def restored(data: np.ndarray, offs: np.ndarray, restorer: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """The rows' restored texts as a byte buffer."""
    odd = np.flatnonzero(suspicious(data, offs))
    if not len(odd):
        return data, offs
    rows = [data[s:e].tobytes() for s, e in zip(offs[:-1].tolist(), offs[1:].tolist())]
    for i in odd.tolist():
        rows[i] = restorer.restore(rows[i].decode()).encode()
    return _joined(rows)


def word_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word and its prefixes, letters lower-cased and squeezed."""
    low = lower(data)
    again = np.zeros(len(low), bool)
    again[1:] = (low[1:] == low[:-1]) & (low[1:] >= 97) & (low[1:] <= 122)
    again[offs[:-1][offs[:-1] < len(low)]] = False
    low = low[~again]
    offs = offs - np.concatenate([[0], np.cumsum(again)])[offs]
    s, e, row = runs(_is_letter[low], offs)
    hasher = SpanHasher(low)
    rows, hashes = [row], [hasher.spans(s, e)]
    for n in PREFIXES:
        longer = e - s > n
        rows.append(row[longer])
        hashes.append(hasher.spans(s[longer], s[longer] + n) ^ np.uint64(0x5DEECE66D))
    return np.concatenate(rows), np.concatenate(hashes)


@dataclass
class Scorer:
    hashes: np.ndarray
    weight: np.ndarray
    rest: float
    costs: np.ndarray

    def __post_init__(self) -> None:
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.restorer = Restorer(self.costs)

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        row, h = word_features(*restored(data, offs, self.restorer))
        out = np.full(len(offs) - 1, self.rest)
        maybe = np.flatnonzero(self.sieve[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), max(0, len(self.hashes) - 1))
        if len(self.hashes):
            sure = self.hashes[at] == h[maybe]
            np.maximum.at(out, row[maybe[sure]], self.weight[at[sure]])
        return out


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Scorer:
    """A scorer; the language model is counted from all texts, without labels."""
    costs = language_model(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(costs)
    texts = durable(training_texts(docs, sampled(labels, label_col, id_col, modulus, held, rows), id_col, text_col))

    def features(batch: pa.RecordBatch) -> dict:
        label = batch.column("label").to_numpy(zero_copy_only=False)
        restorer, found = Restorer(shared.value), {0: [np.zeros(0, np.uint64)], 1: [np.zeros(0, np.uint64)]}
        for a, _, data, offs in pieces(batch.column("text")):
            row, h = word_features(*restored(data, offs, restorer))
            for r in range(len(offs) - 1):
                found[int(label[a + r] != 0)].append(np.unique(h[row == r]))
        both = [np.unique(np.concatenate(found[k]), return_counts=True) for k in (0, 1)]
        return {
            "h": np.concatenate([both[0][0], both[1][0]]).view(np.int64),
            "clean": np.concatenate([both[0][1], np.zeros(len(both[1][1]), np.int64)]),
            "toxic": np.concatenate([np.zeros(len(both[0][1]), np.int64), both[1][1]]),
        }

    columns = {"text": F.col("text"), "label": F.col("label")}
    counted = map_batches(texts, columns, features, "h bigint, clean bigint, toxic bigint")
    likely = counted.groupBy("h").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("toxic >= 3 AND toxic > clean")
    candidates = np.sort(likely.select("h").toArrow().column("h").to_numpy().view(np.uint64))
    chosen = docs.sparkSession.sparkContext.broadcast(candidates)

    def present(batch: pa.RecordBatch) -> dict:
        restorer, found = Restorer(shared.value), []
        for _, _, data, offs in pieces(batch.column("text")):
            row, h = word_features(*restored(data, offs, restorer))
            at = np.minimum(np.searchsorted(chosen.value, h), max(0, len(chosen.value) - 1))
            ok = chosen.value[at] == h if len(chosen.value) else np.zeros(len(h), bool)
            found += [np.unique(at[ok & (row == r)]) for r in range(len(offs) - 1)]
        return {"label": batch.column("label"), "at": found}

    table = map_batches(texts, columns, present, "label int, at array<bigint>").toArrow()
    y = table.column("label").to_numpy() != 0
    telling, weight = decision_list([x.values.to_numpy() for x in table.column("at")], y, len(candidates))
    return Scorer(candidates[telling], weight, min(0.4, (y.sum() + 0.5) / (len(y) + 1) / 4), costs)


def decision_list(rows: list[np.ndarray], y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, weight), by feature: each in turn best explains the rows that are left.

    A feature is taken while its share of toxic rows among those is above the
    base rate beyond what trying all ``n`` features yields by chance; its
    weight is the lower bound of that share.
    """
    base = (y.sum() + 0.5) / (len(y) + 1)
    where: list[list[int]] = [[] for _ in range(n)]
    for r, fs in enumerate(rows):
        for f in fs.tolist():
            where[f].append(r)
    toxic = np.array([y[w].sum() for w in where], float)
    clean = np.array([len(w) for w in where], float) - toxic
    left, chosen, weights = np.ones(len(y), bool), [], []
    while n:
        share = toxic / np.maximum(1, toxic + clean)
        gain = toxic * np.log(np.maximum(share, 1e-9) / base) + clean * np.log(np.maximum(1 - share, 1e-9) / (1 - base))
        gain[share <= base] = 0
        f = int(np.argmax(gain))
        if gain[f] <= np.log(max(2, n)):
            break
        m = toxic[f] + clean[f]
        p = (toxic[f] + 0.5) / (m + 1)
        chosen.append(f)
        weights.append(p - np.sqrt(p * (1 - p) / m))
        for r in where[f]:
            if left[r]:
                left[r] = False
                (toxic if y[r] else clean)[rows[r]] -= 1
    order = np.argsort(chosen) if chosen else np.zeros(0, int)
    return np.array(chosen, int)[order], np.array(weights)[order]


def score(docs: DataFrame, scorer: Scorer, modulus: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts have no word and get the least score; a null id is
    not held out; repeated rows score alike; an empty table gives no rows; with
    labels of one class or none nothing is telling.  Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def fn(batch: pa.RecordBatch) -> dict:
        s = np.concatenate([shared.value.scores(d, o) for _, _, d, o in pieces(batch.column("text"))])
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    columns = {
        "doc_id": F.col(id_col).cast("long"),
        "held_out": F.coalesce(remainder(F.col(id_col), modulus) == held, F.lit(False)),
        "text": F.col(text_col).cast("string"),
    }
    return map_batches(docs, columns, fn, "doc_id bigint, held_out boolean, score double, predicted int")


def restore_column(docs: DataFrame, costs: np.ndarray, text_col: str = "text", out_col: str = "restored") -> DataFrame:
    """``docs`` with each text's most likely plain reading after its columns."""
    shared = docs.sparkSession.sparkContext.broadcast(costs)

    def fn(texts: pa.Array) -> dict:
        restorer = Restorer(shared.value)
        return {out_col: [restorer.restore(t.as_py() or "") for t in texts]}

    return append_columns(docs, text_col, fn, f"{out_col} string")


def drop_toxic(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` predicted clean, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def fn(texts: pa.Array) -> dict:
        return {"__toxic": np.concatenate([shared.value.scores(d, o) for _, _, d, o in pieces(texts)])}

    return append_columns(docs, text_col, fn, "__toxic double").where("__toxic < 0.5").drop("__toxic")
