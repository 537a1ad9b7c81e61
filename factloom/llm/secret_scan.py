"""Secret scan: keyword prefilter, anchored expressions near hits, checksums.

An Aho-Corasick automaton finds the keywords of a text in one pass; a text
without any is skipped, and at a hit an expression anchored there is tried.
Kinds that embed a checksum are kept only if it is right:

* ``github`` and ``npm``: the last six characters are the CRC-32 of the 30
  before them, in base 62;
* ``wif``: a base58 private key ending in four bytes of a double SHA-256 (its
  keywords are the openings that such keys can have);
* ``jwt`` (header and payload must decode to JSON objects; it begins where a run
  of its letters does);
* ``private_key`` (a PEM block; its body must be base64) and ``slack``,
  ``stripe``, ``google`` by shape, which embed none.

Base kinds ``assign``, ``access`` and ``hex`` are found everywhere and stay.
Null texts count as empty; JSON nested too deeply to be read is none; a text of
any length takes time in proportion.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm._text import append_columns, map_batches

Span = tuple[int, int, str]

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KIND_ORDER = ["assign", "access", "hex", "github", "npm", "wif", "jwt", "private_key", "slack", "stripe", "google"]

_B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_B58 = {c: i for i, c in enumerate("123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz")}


def crc_base62(body: str) -> str:
    """CRC-32 of ``body`` as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = _B62[r] + out
    return out.rjust(6, "0")


def _crc_ok(m: re.Match) -> bool:
    return crc_base62(m[1][:-6]) == m[1][-6:]


def _wif_ok(m: re.Match) -> bool:
    n = 0
    for c in m[0]:
        n = n * 58 + _B58[c]
    raw = n.to_bytes(38, "big") if n < 1 << 304 else b""
    raw = raw.lstrip(b"\0")
    body, check = raw[:-4], raw[-4:]
    return len(body) in (33, 34) and body[0] == 0x80 and hashlib.sha256(hashlib.sha256(body).digest()).digest()[:4] == check


def _json_part(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except (ValueError, RecursionError):
        return False


def _jwt_ok(m: re.Match) -> bool:
    return _json_part(m[1]) and _json_part(m[2])


def _pem_ok(m: re.Match) -> bool:
    try:
        return len(base64.b64decode("".join(m[2].split()), validate=True)) >= 16
    except ValueError:
        return False


def _any(_: re.Match) -> bool:
    return True


_WIF = re.compile(r"(?<![1-9A-HJ-NP-Za-km-z])[5KL][1-9A-HJ-NP-Za-km-z]{50,51}(?![1-9A-HJ-NP-Za-km-z])")
_CRC = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
#: keyword -> (kind, expression anchored at the keyword's start, validation)
RULES = {
    **{f"gh{c}_": ("github", _CRC, _crc_ok) for c in "pousr"},
    "npm_": ("npm", _CRC, _crc_ok),
    "eyJ": ("jwt", re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+"), _jwt_ok),
    "-----BEGIN ": ("private_key", re.compile(r"-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----"), _pem_ok),
    **{f"xox{c}-": ("slack", re.compile(r"xox[abprs]-[0-9A-Za-z-]{20,}"), _any) for c in "abprs"},
    **{f"{k}_live_": ("stripe", re.compile(r"[sr]k_live_[0-9A-Za-z]{16,}"), _any) for k in ("sk", "rk")},
    **{k: ("wif", _WIF, _wif_ok) for k in ("5H", "5J", "5K", "Kw", "Kx", "Ky", "Kz", "L1", "L2", "L3", "L4", "L5")},
    "AIza": ("google", re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"), _any),
}
_BASE_WORDS = ["password", "passwd", "secret", "token", "api_key", "apikey"]


def _automaton(words: list[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in words:
        a.add_word(w, w)
    a.make_automaton()
    return a


_AUTOMATA: list[ahocorasick.Automaton] = []


def base_spans(text: str) -> list[Span]:
    """The base kinds' spans, failing matches dropped without a retry."""
    found = [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + _assignments(text)


def _assignments(text: str) -> list[Span]:
    """Assignments, tried only where their keyword stands."""
    if ":" not in text and "=" not in text:
        return []
    # lower-casing ASCII letters alone keeps every position
    low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    found, free = [], 0
    for at in sorted(end - len(word) + 1 for end, word in _automata()[1].iter(low)):
        if at >= free and (m := _ASSIGN.match(text, at)):
            free = m.end()
            if m.end(1) - m.start(1) >= 6:
                found.append((m.start(), m.end(), "assign"))
    return found


def _automata() -> list[ahocorasick.Automaton]:
    if not _AUTOMATA:
        _AUTOMATA.extend([_automaton(list(RULES)), _automaton(_BASE_WORDS)])
    return _AUTOMATA


def keyword_spans(text: str) -> list[Span]:
    """Spans of the keyword rules, leftmost and non-overlapping per kind."""
    found, free = [], {}
    for end, word in _automata()[0].iter(text):
        kind, pattern, valid = RULES[word]
        at = end - len(word) + 1
        if at >= free.get(kind, 0) and (m := pattern.match(text, at)) and valid(m):
            found.append((m.start(), m.end(), kind))
            free[kind] = m.end()
    return found


def ordered(spans: list[Span], order: list[str]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], order.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of one text in order."""
    if not text:
        return [], []
    base = base_spans(text)
    return ordered(base, _KIND_ORDER), ordered(base + keyword_spans(text), _KIND_ORDER)


def _each(texts: pa.Array) -> Iterator[tuple[list[Span], list[Span]]]:
    return (find(t.as_py()) for t in texts)


def secret_spans(df: DataFrame, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """``df`` with its secrets as array<string> of ``kind:start:end``."""

    def fn(texts: pa.Array) -> dict:
        return {out_col: [[f"{k}:{s}:{e}" for s, e, k in every] for _, every in _each(texts)]}

    return append_columns(df, text_col, fn, f"{out_col} array<string>")


def secret_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""

    def fn(batch: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for base, every in _each(batch.column("text")):
            kinds = [k for _, _, k in base]
            for k in ("assign", "access", "hex"):
                out[f"n_{k}"].append(kinds.count(k))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(every))
        return {"doc_id": batch.column("doc_id"), **out}

    columns = {"doc_id": F.col(id_col).cast("long"), "text": F.col(text_col).cast("string")}
    return map_batches(df, columns, fn, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
