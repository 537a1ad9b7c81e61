"""BPE encoding and decoding by forced-boundary splitting.

A pair of adjacent bytes that occurs inside no vocabulary token can never be
merged, so a cut between them is certain: the pairs are computed from the
vocabulary (``Codec.forced``).  Every text is cut at each forced pair where the
pre-tokenizer, too, gives the same pieces on either side (``Codec.cuts``); the
fragments are encoded independently, by the pre-tokenizer's expression and the
file's merge table, and their ids concatenated.

Why a cut between characters c and d is safe when their pair is forced, c is no
white space, and d is no apostrophe after a sign: (1) the pre-tokenizer looks at
most one character ahead, and only behind white space, so what is left of the
cut is split as before, the last piece ending at the cut.  (2) If a piece ended
there anyway, the rest is split as before.  (3) Else c and d are of one class, as
no piece mixes classes but in contractions ('s, 'll ...), whose pairs are never
forced, and the rest of the piece is matched by its class alone; only an
apostrophe could begin a contraction that it did not begin before, hence the
condition on d.  (4) No merge of the piece spans the cut, so the merges of its
halves don't see each other.

Each distinct fragment is encoded once per worker and remembered.  Null texts
count as empty: no tokens, and the hashes of empty strings.  A text may be of
any length; merging takes n log n time in a stretch without a forced pair.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.models import BPE

from factloom.llm._features import pieces
from factloom.llm._text import append_columns, map_batches

#: Fragments remembered by one worker, and the bytes of one; memory only.
CACHE_FRAGMENTS, CACHE_BYTES = 400_000, 256
_PIECES = regex.compile(r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_CONTRACTIONS = [b"'s", b"'d", b"'m", b"'t", b"'ll", b"'ve", b"'re"]
_SPACES = [chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_ONE_BYTE_SPACE = np.zeros(256, bool)
_ONE_BYTE_SPACE[[ord(c) for c in _SPACES if ord(c) < 128]] = True
#: Last two bytes of white space of several bytes (the third from the end is checked apart).
_LONG_SPACE = np.zeros(1 << 16, bool)
_LONG_SPACE[[e[-2] << 8 | e[-1] for e in (c.encode() for c in _SPACES) if len(e) > 1]] = True
_LEADS = {2: {0xC2}, 3: {0xE1, 0xE2, 0xE3}}
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in keep}
    for k, b in enumerate(b for b in range(256) if b not in keep):
        letters[chr(256 + k)] = b
    return letters


class _Fragments(dict):
    """Fragment -> its ids, as bytes."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, fragment: bytes) -> bytes:
        ids = self.codec.fragment(fragment)
        if len(fragment) <= CACHE_BYTES:
            if len(self) >= CACHE_FRAGMENTS:
                self.clear()
            self[fragment] = ids
        return ids


class Codec:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in added}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        #: Merges the bytes of one piece; knows nothing of texts or pre-tokens.
        self.model = BPE(vocab=vocab, merges=merges, cache_capacity=0)
        self.letter = {b: c for c, b in letters.items()}
        inside = np.zeros((256, 256), bool)
        for t in self.bytes_of.values():
            for a, b in zip(t, t[1:]):
                inside[a, b] = True
        #: forced[a, b]: bytes a, b stand together in no token.
        self.forced = ~inside
        fit = self.forced.copy()
        for t in _CONTRACTIONS:
            for a, b in zip(t, t[1:]):
                fit[a, b] = False
        fit[_ONE_BYTE_SPACE, :] = False  # no cut behind white space,
        fit[:, 0x80:0xC0] = False  # within a character,
        fit[~_WORD_BYTE, ord("'")] = False  # or between a sign and an apostrophe
        #: fit[a << 8 | b]: a forced pair at which a text may be cut, if a ends no white space of several bytes.
        self.fit = fit.ravel()
        self.bytes_of |= {i: t.encode() for t, i in added.items()}
        self.added = {t.encode(): i for t, i in added.items()}
        self.special = regex.compile(b"|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if added else None
        self.fragments = _Fragments(self)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Positions in UTF-8 bytes before which the text is cut, each between a forced pair."""
        if len(data) < 2:
            return np.zeros(0, np.int64)
        pair = data[:-1].astype(np.uint16) << 8 | data[1:]
        at = np.flatnonzero(self.fit[pair]) + 1
        odd = np.flatnonzero((data[at - 1] >= 0x80) & _LONG_SPACE[pair[np.maximum(at - 2, 0)]])
        if len(odd):
            lead2, lead3 = data[at[odd] - 2], data[np.maximum(at[odd] - 3, 0)]
            space = np.isin(lead2, list(_LEADS[2])) | np.isin(lead3, list(_LEADS[3])) & (lead2 < 0xC0)
            at = np.delete(at, odd[space])
        return at

    def piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: its bytes merged by the file's merge table."""
        return [t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.letter))]

    def fragment(self, fragment: bytes) -> bytes:
        ids = array("I")
        for p in _PIECES.findall(fragment.decode("utf-8", "surrogatepass")):
            ids.extend(self.piece(p.encode("utf-8", "surrogatepass")))
        return ids.tobytes()

    def encode_rows(self, data: np.ndarray, offs: np.ndarray) -> list[bytes]:
        """Ids of each row of a byte buffer, as little-endian unsigned 32-bit integers."""
        raw = data.tobytes()
        if self.special is not None and (found := [(m.start(), m.end(), m[0]) for m in self.special.finditer(raw)]):
            return self._with_special(raw, offs, found)
        edges = np.unique(np.concatenate([self.cuts(data), offs]))
        at = edges.tolist()
        ids = [*map(self.fragments.__getitem__, [raw[s:e] for s, e in zip(at, at[1:])])]
        first = np.searchsorted(edges, offs).tolist()
        return [b"".join(ids[s:e]) for s, e in zip(first, first[1:])]

    def _with_special(self, raw: bytes, offs: np.ndarray, found: list[tuple[int, int, bytes]]) -> list[bytes]:
        """Rows with added tokens: those stand for themselves, the text around them is encoded as rows."""
        at, owner, rows = offs.tolist(), np.searchsorted(offs, [s for s, _, _ in found], "right") - 1, []
        inner: list[list[tuple[int, int, bytes]]] = [[] for _ in at[1:]]
        for span, r in zip(found, owner.tolist()):
            if span[1] <= at[r + 1]:
                inner[r].append(span)
        for r, (s, e) in enumerate(zip(at, at[1:])):
            out, here = [], s
            for a, b, token in [*inner[r], (e, e, b"")]:
                part = raw[here:a]
                out += self._plain(part)
                if token:
                    out.append(np.array([self.added[token]], "<u4").tobytes())
                here = b
            rows.append(b"".join(out))
        return rows

    def _plain(self, part: bytes) -> list[bytes]:
        at = [0, *self.cuts(np.frombuffer(part, np.uint8)).tolist(), len(part)]
        return [self.fragments[part[s:e]] for s, e in zip(at, at[1:])] if part else []

    def encode(self, text: str | None) -> bytes:
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        return self.encode_rows(data, np.array([0, len(data)]))[0]

    def decode(self, ids: bytes) -> str:
        of = self.bytes_of.__getitem__
        return b"".join(map(of, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a file, built once per process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encoded(texts: pa.Array, path: str) -> list[bytes]:
    """The ids of each text of an array."""
    return [ids for _, _, data, offs in pieces(texts) for ids in codec(path).encode_rows(data, offs)]


def encode_column(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the ids of each text as array<int> after its columns."""

    def fn(texts: pa.Array) -> dict:
        return {ids_col: [np.frombuffer(ids, "<i4") for ids in encoded(texts, path)]}

    return append_columns(df, text_col, fn, f"{ids_col} array<int>")


def decode_column(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of each id list after its columns; null decodes to ''."""

    def fn(ids: pa.Array) -> dict:
        return {text_col: [codec(path).decode(np.array(x.as_py() or [], "<u4").tobytes()) for x in ids]}

    return append_columns(df, ids_col, fn, f"{text_col} string")


def bpe_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""

    def fn(batch: pa.RecordBatch) -> dict:
        n, a, b = [], [], []
        for ids in encoded(batch.column("text"), path):
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(hashlib.sha256(codec(path).decode(ids).encode()).hexdigest())
        return {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

    columns = {"doc_id": F.col(id_col).cast("long"), "text": F.col(text_col).cast("string")}
    return map_batches(df, columns, fn, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
