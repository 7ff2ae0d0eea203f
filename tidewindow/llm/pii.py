"""Personal data by anchor expansion.

One Aho-Corasick pass over a text, its ASCII letters lowered, finds anchors: at-signs,
digits before a stop, digit pairs, plus signs before a digit, schemes and identifier cues.
From an anchor a deterministic parser expands to the boundaries of the item in the text as
it stands and validates it, so cues and schemes count in any case.

Kinds, in the order in which spans are listed: email, ip, card, phone (the base kinds),
url (behind a scheme) and account (an IBAN, an access key, or a value behind a cue such as
``token =``). Spans are in code points, the end exclusive. Within a kind they do not
overlap; an item that fails its validation is dropped and its characters are not tried again.

Defined results: a null or empty text has no spans; repeated rows each give their row; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewindow.llm.common import small_batches, text_or_empty

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
#: The shapes of the items, tried only at an anchor.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"[A-Za-z]+://[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?::[0-9]+)?(?:[/?#][^\s<>\"'`]*)?")
VALUE = re.compile(r"""\s*[=:]\s*["']?([A-Za-z0-9+/_-]{16,})""")
KEY = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Z])")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
GAP = re.compile(r"\W{0,3}")
UPPER = re.compile(r"[A-Z]+")
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("token", "secret", "password", "api_key", "apikey", "account")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    words: dict[str, tuple[str, int]] = {"@": ("email", 0)}
    for x in "0123456789":
        words[f"{x}."] = ("ip", 1)
        words[f"+{x}"] = ("phone", 1)
        for y in "0123456789":
            for gap in ("", " ", "-"):
                words[f"{x}{gap}{y}"] = ("card", 1 + len(gap))
    words |= {s: ("url", len(s) - 1) for s in SCHEMES}
    words |= {c: ("cue", len(c) - 1) for c in CUES} | {"akia": ("key", 3), "iban": ("iban", 3)}
    for w, v in words.items():
        a.add_word(w, v)
    a.make_automaton()
    return a


_anchors = _automaton()


def lowered(text: str) -> str:
    """The text with ASCII letters in lower case, at the same offsets."""
    return text.lower() if text.isascii() else UPPER.sub(lambda m: m[0].lower(), text)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of all items, by kind and start."""
    out: list[tuple[int, int, int]] = []
    done = dict.fromkeys((*KINDS, "cue", "key", "iban"), 0)  # where the last item of the kind ended, kept or not
    for at, (kind, back) in _anchors.iter(lowered(text)):
        start, limit = at - back, done[kind]
        if start < limit:
            continue
        if kind == "email":
            s = start
            while s > limit and text[s - 1] in LOCAL:
                s -= 1
            m = DOMAIN.match(text, start) if s < start else None
            if m:
                out.append((0, s, m.end()))
                done[kind] = m.end()
        elif kind == "ip":
            s = start
            while s > limit and text[s - 1] in DIGITS:
                s -= 1
            m = ADDRESS.match(text, s)
            if m:
                done[kind] = m.end()
                if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                    out.append((1, s, m.end()))
        elif kind == "card":
            m = CARD.match(text, start)
            done[kind] = m.end()
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, start, m.end()))
        elif kind == "phone":
            m = PHONE.match(text, start)
            if m:
                done[kind] = m.end()
                if 8 <= sum(c in DIGITS for c in m[0]) <= 15:
                    out.append((3, start, m.end()))
        elif kind == "url":
            m = URL.match(text, start)
            if m:
                end = start + len(m[0].rstrip(".,;:!?)"))
                done[kind] = end
                out.append((4, start, end))
        elif kind == "cue":
            m = VALUE.match(text, at + 1)
            if m and any(c in DIGITS for c in m[1]):
                done[kind] = m.end()
                out.append((5, m.start(1), m.end()))
        elif kind == "key":
            m = KEY.match(text, start)
            if m and (start == 0 or not text[start - 1].isalnum()):
                done[kind] = m.end()
                out.append((5, start, m.end()))
        else:
            m = IBAN.match(text, GAP.match(text, at + 1).end())
            if m and iban(m[0]):
                done[kind] = m.end()
                out.append((5, m.start(), m.end()))
    out.sort()
    return [x for k, x in enumerate(out) if not k or x[0] != out[k - 1][0] or x[1] >= out[k - 1][2]]


def pii_spans(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, spans array<struct<kind, start, end>>`` of every row."""
    small_batches(docs.sparkSession)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spans(t) for t in b.column(1).to_pylist()]
            flat = [s for f in found for s in f]
            offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            items = pa.StructArray.from_arrays([pa.array([KINDS[k] for k, _, _ in flat], pa.string()), pa.array([s for _, s, _ in flat], pa.int64()), pa.array([e for _, _, e in flat], pa.int64())], fields=list(span))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, items)], ["k", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
    return rows.mapInArrow(find, f"k {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("k", key)


def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with each item in ``text`` replaced by its kind in brackets; nulls stay null."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def blanked(texts):
        def one(t):
            if t is None:
                return None
            parts, at = [], 0
            for k, s, e in sorted(spans(t), key=lambda x: (x[1], -x[2])):
                if s >= at:
                    parts += [t[at:s], f"[{KINDS[k]}]"]
                    at = e
            return "".join(parts) + t[at:]

        return texts.map(one, na_action="ignore")

    return docs.withColumn(text, blanked(text))


def listed(spans_: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row."""
    found = pii_spans(docs, text=text, key=key)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(key, *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
