"""PII: base expressions, and a character BiLSTM-CRF for what they miss.

The network is trained from labelled spans: texts of a bounded sample of
documents (``SAMPLE_ROWS``, cut to windows), with the base kinds labelled where
they stand and other written forms (spelled-out or spaced addresses, grouped
numbers, national ids, IBANs, IPv6) put in at random, seeded places.  Texts are
decoded in overlapping windows.  Where a span touches a window's edge and no
other window holds it whole, windows of twice the size are decoded there, and so
on until every span of ``LONGEST`` characters fits; longer ones are of no valid
form.  A span is carried on to the end of the word or number that it ends in, so
that no part of an address is taken for the whole.  The spans of all windows are
reconciled over the whole text by weighted interval scheduling, a span counting
more the more windows agree on it, and never displacing a base span.

A span must hold a digit, an at-sign, a bracketed "at" or "dot", the word "dot",
or the word "at" before a host with a dot to be valid (``_ANCHOR``), so windows
without one are not decoded: they could add nothing.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import bilstm_crf
from factloom.llm._text import append_columns, map_batches

Span = tuple[int, int, str]

KINDS = ["email", "ip", "card", "phone", "ssn", "iban"]
#: Documents whose texts the network is trained in, and windows taken of each.
SAMPLE_ROWS, SAMPLE_WINDOWS = 400, 2
HIDDEN, STEPS, BATCH, TRAIN_LENGTH, SEED = 16, 500, 40, 96, 7
#: Every fourth batch trains long addresses in longer windows.
LONG_EVERY, LONG_LENGTH = 4, 192
WINDOW, DECODE = 128, 256
#: Windows whose texts are decoded together, whatever the batch holds; a text with more is decoded by itself.
GROUP = 1 << 13
#: Characters of the longest valid span: an address has at most 320 (RFC 5321), and is written out in at most this many.
LONGEST = 1000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match starts where its run of digits does, so later starts are not tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_ANCHOR = re.compile(r"[0-9@]|(?i:[\[({<]\s*(?:at|dot)\s*[\])}>]|(?<![^\W_])dot(?![^\W_])|(?<=\s)at\s+[a-z0-9-]{1,63}(?:\.|\s+\.\s+)[a-z0-9-])")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[Span]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, m.end(), "email"))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[Span]:
    """The base kinds' spans, failing matches dropped without a retry."""
    found = _emails(text)
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append((m.start(), m.end(), "card"))
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# Written forms for training


def _made(r: random.Random, long: bool = False) -> Span | tuple[str, str]:
    """(text, kind) of one made-up span, or of a ``long`` address; kind '' for a number that is none."""
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda a=2, b=8: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(a, b)))
    pick = 0.0 if long else r.random()
    if pick < 0.24:
        user = w() + r.choice(["", ".", "_", "-"]) + r.choice(["", n(2), w()])
        if long:
            user = r.choice(["", "", ".", "_", "-"]).join(w(1, 12) + r.choice(["", "", n(1)]) for _ in range(r.randint(2, 18)))
        user = user.rstrip("._-")
        host, tld = w(3, 9), r.choice(["com", "org", "net", "de", "fr", "es", "edu", "io", "co.uk", "example.com"])
        at = r.choice(["@", "@", " @ ", " [at] ", "[at]", " (at) ", "(at)", " at ", " AT ", " {at} ", "@"])
        dot = r.choice([" dot ", " [dot] ", "[dot]", " (dot) ", " DOT ", " . "]) if at.strip("@ ") or r.random() < 0.3 else "."
        if at in (" at ", " AT ") and dot == ".":
            dot = " dot "
        return user + at + host + dot + tld.replace(".", dot), "email"
    if pick < 0.36:
        if r.random() < 0.4:
            return ".".join(str(r.randint(0, 255)) for _ in range(4)), "ip"
        if r.random() < 0.4:
            return r.choice([" . ", "[.]", "(.)", " dot "]).join(str(r.randint(1, 255)) for _ in range(4)), "ip"
        parts = ["%x" % r.randint(0, 65535) for _ in range(8)]
        return (":".join(parts) if r.random() < 0.5 else ":".join(parts[:2]) + "::" + ":".join(parts[2 : r.randint(3, 5)])), "ip"
    if pick < 0.52:
        d = r.choice("345") + n(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice(["", " ", "-", ".", "/", "_", "  "])
        return sep.join(d[k : k + 4] for k in range(0, 16, 4)), "card"
    if pick < 0.72:
        a, b, c = n(3), n(3), n(4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"00{n(2)} {n(3)} {n(7)}", f"0{n(3)} {n(3)} {n(4)}", f"+{n(2)}/{n(3)}/{n(7)}", f"0{n(1)} {n(2)} {n(2)} {n(2)} {n(2)}", f"0{n(3)}/{n(7)}"]), "phone"
    if pick < 0.80:
        return f"{n(3)}{(s := r.choice('- -'))}{n(2)}{s}{n(4)}", "ssn"
    if pick < 0.88:
        body = n(18)
        check = 98 - int(body + "131400") % 97
        iban = f"DE{check:02d}{body}"
        return (iban if r.random() < 0.5 else " ".join(iban[k : k + 4] for k in range(0, 22, 4))), "iban"
    hexes = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([18, 32, 40])))
    return r.choice([n(4), n(8), n(2), f"{n(1)}.{n(1)}", f"{n(2)}.{n(2)}.{n(4)}", f"{n(4)}-{n(2)}-{n(2)}", f"password={hexes}", f'token = "{hexes}"', f"{n(2)}%", f"${n(3)},{n(3)}.{n(2)}", f"{n(1)}.{n(1)}.{n(1)}", f"v{n(1)}.{n(2)}", f"AKIA{w(16, 16).upper()}", f"{n(2)}:{n(2)}:{n(2)}"]), ""


_TAGS = 1 + 2 * len(KINDS)


def _tagged(text: str, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(len(text), np.int64)
    for s, e, kind in spans:
        k = KINDS.index(kind)
        tags[s] = 1 + 2 * k
        tags[s + 1 : e] = 2 + 2 * k
    return tags


def _free_of_overlap(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for s in spans:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def training_batches(contexts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Seeded (classes, tags) batches from windows of texts with spans put in."""
    r, out = random.Random(SEED), []
    contexts = sorted(c for c in contexts if c.strip()) or ["the of and a to in is it "]
    for step in range(STEPS):
        xs, ys = [], []
        long = step % LONG_EVERY == 0
        length = LONG_LENGTH if long else TRAIN_LENGTH
        for _ in range(BATCH // 2 if long else BATCH):
            text = r.choice(contexts)
            spans = _free_of_overlap(base_spans(text))
            if not spans or r.random() < 0.7:
                made, kind = _made(r, long and r.random() < 0.7)
                gaps = [m.start() for m in re.finditer(" ", text) if not any(b <= m.start() < e for b, e, _ in spans)] or [0]
                at = r.choice(gaps)
                left = text[:at] + (r.choice([" ", " ", " ", "\n", " (", ": ", ""]) if at else "")
                right = r.choice(["", "", ".", ",", ")"]) + ("" if text[at : at + 1] == " " else " ") + text[at:]
                moved = len(left) + len(made) + len(right) - len(text)
                own = [(len(left), len(left) + len(made), kind)] if kind else []
                spans = [x for x in spans if x[1] <= at] + own + [(b + moved, e + moved, k) for b, e, k in spans if b >= at]
                text = left + made + right
            first = min((s[0] for s in spans), default=0)
            cut = max(0, first - r.randint(0, TRAIN_LENGTH // 2))
            x, y = bilstm_crf.codes(text)[cut : cut + length], _tagged(text, spans)[cut : cut + length]
            pad = length - len(x)
            xs.append(np.pad(x, (0, pad), constant_values=10))
            ys.append(np.pad(y, (0, pad)))
        out.append((np.stack(xs, 1), np.stack(ys, 1)))
    return out


_TRAINED: dict[str, bilstm_crf.Network] = {}


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> bilstm_crf.Network:
    """The network, trained in windows of a bounded sample of documents."""
    ids = docs.select(F.col(id_col).cast("long").alias("__id")).where("__id IS NOT NULL").groupBy("__id").agg(F.xxhash64("__id").alias("__k")).orderBy("__k", "__id").limit(rows)

    def windows(batch: pa.RecordBatch) -> dict:
        out = []
        for text in batch.column("text").to_pylist():
            places = [max(0, s - 100) for s, _, _ in base_spans(text)[:1]] + [len(text) * k // SAMPLE_WINDOWS for k in range(SAMPLE_WINDOWS)]
            out += [text[p : p + 200] for p in places[:SAMPLE_WINDOWS]]
        return {"window": out}

    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids.select("__id")), "__id", "left_semi")
    contexts = sorted(set(map_batches(texts, {"text": F.col("text")}, windows, "window string").toArrow().column("window").to_pylist()))
    key = hashlib.sha256("\0".join(contexts).encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _TRAINED:
        _TRAINED.clear()
        _TRAINED[key] = bilstm_crf.train(training_batches(contexts), HIDDEN, _TAGS, SEED)
    return _TRAINED[key]


# Decoding


def _spelled(s: str) -> str:
    s = re.sub(r"\s+", " ", s)
    s = re.sub(r"\s*[\[({<]?\s*\bdot\b\s*[\])}>]?\s*|\s*[\[(]\.[\])]\s*|\s+\.\s+", ".", s, flags=re.I)
    return re.sub(r"\s*[\[({<]\s*at\s*[\])}>]\s*|\s+at\s+|\s+@\s+", "@", s, flags=re.I)


_EMAIL_FORM = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IPV6 = re.compile(r"(?=[^:]*:[^:]*:)[0-9A-Fa-f:]{6,39}")


def _iban_ok(s: str) -> bool:
    s = re.sub(r"[ -]", "", s).upper()
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def valid(kind: str, s: str) -> bool:
    """Whether a decoded span can be what it is said to be."""
    if len(s) > LONGEST or not _ANCHOR.search(s):
        return False
    d = _digits(s)
    if kind == "email":
        return len(s := _spelled(s)) <= 320 and bool(_EMAIL_FORM.fullmatch(s))
    if kind == "ip":
        parts = _spelled(s).split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts) or bool(_IPV6.fullmatch(s)) and s.count(":") >= 3 and all(len(p) <= 4 for p in s.split(":"))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and not re.search(r"[A-Za-z]", s)
    if kind == "phone":
        return 9 <= len(d) <= 15 and not re.search(r"[^0-9 ()+./-]", s) and bool(re.search(r"[0-9)][ ()./-]+[0-9]", s)) and not re.fullmatch(r"\d{1,4}([./-])\d{1,2}\1\d{1,4}", s)
    if kind == "ssn":
        return bool(re.fullmatch(r"(?!000|666|9)\d{3}([- ])(?!00)\d{2}\1(?!0000)\d{4}", s, re.A))
    return _iban_ok(s)


def reconcile(base: list[Span], proposed: dict[Span, int]) -> list[Span]:
    """Base spans, and the heaviest set of proposed ones that overlap neither them nor each other."""
    taken = sorted((s, e) for s, e, _ in base)
    ends: list[int] = []
    for _, e in taken:
        ends.append(max(e, ends[-1] if ends else 0))
    starts = [s for s, _ in taken]
    free = []
    for (s, e, kind), votes in proposed.items():
        k = bisect_right(starts, e - 1)
        if not k or ends[k - 1] <= s:
            free.append((e, s, kind, votes))
    free.sort()
    finish = [f[0] for f in free]
    best: list[tuple[int, int]] = [(0, -1)]  # (weight, last chosen) for the first k
    back: list[int] = []
    for k, (e, s, kind, votes) in enumerate(free):
        j = bisect_right(finish, s, 0, k)
        with_it = best[j][0] + votes * 1000 + (e - s)
        back.append(j)
        best.append((with_it, k) if with_it > best[k][0] else best[k])
    chosen, k = [], len(free)
    while k and best[k][1] >= 0:
        at = best[k][1]
        e, s, kind, _ = free[at]
        chosen.append((s, e, kind))
        k = back[at]
    return sorted([*base, *chosen], key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


_BEFORE = {"email": _LOCAL, "iban": set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), "ip": set("0123456789abcdefABCDEF:")}
_DIGITS = set("0123456789")
_ON = re.compile(r"(?:[A-Za-z0-9-]|\.(?=[A-Za-z0-9])|\s?[\[({<]\s?(?i:dot)\s?[\])}>]\s?(?=[A-Za-z0-9]))*")


_WRITTEN = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\s?[\[({<]\s?at\s?[\])}>]\s?|\s+at\s+|\s*@\s*)[A-Za-z0-9-]+(?:(?:\.|\s?[\[({<]\s?dot\s?[\])}>]\s?|\s+dot\s+|\s+\.\s+|\s*[\[(]\.[\])]\s*)[A-Za-z0-9-]+)+", re.I
)


def formed(text: str, s: int, e: int, kind: str) -> Span | None:
    """The valid span that a decoded one stands for: carried on, or for an address the first written form that it lies in or holds."""
    s, e = carried_on(text, s, e, kind)
    if valid(kind, text[s:e]):
        return s, e, kind
    if kind == "email" and e - s <= 2 * LONGEST:
        for m in _WRITTEN.finditer(text, max(0, s - LONGEST), min(len(text), e + LONGEST)):
            if m.start() >= e:
                break
            if m.end() > s and valid(kind, m[0]):
                return *m.span(), kind
    return None


def carried_on(text: str, s: int, e: int, kind: str) -> tuple[int, int]:
    """The span with the rest of the word, address or number that it begins and ends in."""
    more = _BEFORE.get(kind, _DIGITS) if kind != "ip" or ":" in text[s:e] else _DIGITS
    least = max(0, e - LONGEST - 1)  # longer ones are not valid
    while s > least and text[s - 1] in more and text[s] in more:
        s -= 1
    if kind == "email":
        return s, _ON.match(text, e, min(len(text), s + LONGEST + 1)).end() if text[e - 1].isalnum() else e
    most = min(len(text), s + LONGEST + 1)
    while e < most and text[e] in more and text[e - 1] in more:
        e += 1
    return s, e


def _windows(texts: list[str | None], where: list[tuple[int, int]], size: int, net: bilstm_crf.Network) -> Iterator[tuple[int, int, list[Span]]]:
    """(text, place, decoded spans) of windows of ``size`` characters."""
    step = max(1, DECODE * WINDOW // size)
    for a in range(0, len(where), step):
        part = where[a : a + step]
        x = np.full((size, len(part)), 10, np.int64)  # of one height, so that no text's spans hang on its neighbours
        for n, (k, at) in enumerate(part):
            c = bilstm_crf.codes(texts[k][at : at + size])
            x[: len(c), n] = c
        tags = bilstm_crf.viterbi(net, bilstm_crf.emissions(net, x))
        for n in np.flatnonzero(tags.any(0)).tolist():
            k, at = part[n]
            yield k, at, [(at + s, min(at + e, len(texts[k])), kind) for s, e, kind in _decoded(tags[:, n]) if at + s < len(texts[k])]


def _grid(a: int, b: int, length: int, size: int) -> range:
    """Places of the windows of ``size`` every half ``size`` that meet [a, b)."""
    stride = size // 2
    last = max(0, -(-(length - size) // stride))
    return range(min(last, max(0, (a - size) // stride + 1)) * stride, min((b - 1) // stride, last) * stride + 1, stride)


def _places(text: str) -> list[int]:
    """Places of the windows that hold an anchor."""
    return sorted({at for m in _ANCHOR.finditer(text) for at in _grid(m.start(), m.start() + 1, len(text), WINDOW)})


def proposals(texts: list[str | None], places: list[list[int]], net: bilstm_crf.Network) -> list[dict[Span, int]]:
    """What the network proposes in the windows at each text's ``places``: valid spans and the number of windows that agree on each."""
    proposed: list[dict[Span, int]] = [{} for _ in texts]
    whole: list[set[tuple[int, int]]] = [set() for _ in texts]
    size = WINDOW
    where = [(k, at) for k, own in enumerate(places) for at in own]
    while where:
        cut: dict[int, set[tuple[int, int]]] = {}
        for k, at, spans in _windows(texts, where, size, net):
            text, here = texts[k], set()
            for s, e, kind in spans:
                if s == at > 0 or e == at + size < len(text):
                    cut.setdefault(k, set()).add((s, e))
                    continue
                whole[k].add((s, e))
                if span := formed(text, s, e, kind):
                    here.add(span)
            for span in here:
                proposed[k][span] = proposed[k].get(span, 0) + 1
        if size // 2 > LONGEST:  # whatever is cut now is longer
            break
        size *= 2
        where = sorted({(k, at) for k, spans in cut.items() for s, e in _unheld(spans, whole[k]) for at in _grid(s - 1, e + 1, len(texts[k]), size)})
    return proposed


def _unheld(cut: set[tuple[int, int]], whole: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of ``cut`` that no span of ``whole`` holds."""
    spans = sorted(whole)
    furthest = [*accumulate((e for _, e in spans), max)]
    return [c for c in cut if not (k := bisect_right(spans, (c[0], 1 << 62))) or furthest[k - 1] < c[1]]


def find_each(texts: Iterable[str | None], net: bilstm_crf.Network) -> Iterator[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, holding no more than a group of texts and their windows."""
    group: list[str | None] = []
    places: list[list[int]] = []
    n = 0
    for text in texts:
        own = _places(text) if text else []
        if n and n + len(own) > GROUP:
            yield from _found(group, places, net)
            group, places, n = [], [], 0
        group.append(text if own else None)  # base spans hold an anchor, too
        places.append(own)
        n += len(own)
    yield from _found(group, places, net)


def _found(texts: list[str | None], places: list[list[int]], net: bilstm_crf.Network) -> Iterator[tuple[list[Span], list[Span]]]:
    for text, proposed in zip(texts, proposals(texts, places, net)):
        base = base_spans(text) if text else []
        yield base, reconcile(base, proposed)


def find(texts: list[str | None], net: bilstm_crf.Network) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    return list(find_each(texts, net))


def _decoded(tags: np.ndarray) -> list[Span]:
    out, n, i = [], len(tags), 0
    while i < n:
        if tags[i]:
            kind = (tags[i] - 1) // 2
            e = i + 1
            while e < n and tags[e] == 2 + 2 * kind:
                e += 1
            out.append((i, e, KINDS[kind]))
            i = e
        else:
            i += 1
    return out


def _each(texts: pa.Array) -> Iterator[str | None]:
    """The texts, made one by one."""
    return (t.as_py() for t in texts)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def pii_digests(docs: DataFrame, net: bilstm_crf.Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row.

    Null and empty texts have no span; repeated rows are treated alike; an
    empty table gives no rows.  Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def fn(batch: pa.RecordBatch) -> dict:
        out: dict = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")}
        for base, every in find_each(_each(batch.column("text")), shared.value):
            kinds = [k for _, _, k in base]
            for k in KINDS[:4]:
                out[f"n_{k}"].append(kinds.count(k))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(every))
        return {"doc_id": batch.column("doc_id"), **out}

    columns = {"doc_id": F.col(id_col).cast("long"), "text": F.col(text_col).cast("string")}
    return map_batches(docs, columns, fn, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def redact_text(text: str, spans: list[Span]) -> str:
    """The text with each span, or chain of overlapping ones, replaced by ``[KIND]`` of its first."""
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, net: bilstm_crf.Network, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced; null texts stay null, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def fn(texts: pa.Array) -> dict:
        found = find_each(_each(texts), shared.value)
        return {text_col: pa.array((None if t is None else redact_text(t, every) for t, (_, every) in zip(_each(texts), found)), pa.string())}

    return append_columns(docs, text_col, fn, f"{text_col} string")
