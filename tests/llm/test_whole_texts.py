"""Fill-in-middle, the filter audit and line deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewindow.llm import filter_audit as audit_module
from tidewindow.llm import scan
from tidewindow.llm.fill_middle import TOKEN, fill_in_middle, restored
from tidewindow.llm.filter_audit import distinct_words, filter_audit
from tidewindow.llm.line_dedup import TwoFilters, dedup_lines, may_repeat
from tidewindow.llm.scan import SPACE, blocks, piece_hashes, same_pieces

CLASHING = "doc_id bigint, text string, source string, id string, n string, form string, output string, part string, mask string, digest string, t string, h string, of string, line_key string"
ODD = "".join(["é", "😀", "a", "B", " ", "\n", "\t", "\x0b", "\xa0", "\x00", "<", "#", "é", "　"])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, *["x"] * 11) for i, t, s in rows], CLASHING)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=ODD, max_size=40), max_size=20), st.integers(1, 60))
def test_pieces_of_blocks(texts, size):
    scan.BLOCK, before = size, scan.BLOCK
    try:
        got = []
        for part in (pa.array(["skipped", *texts]).slice(1), pa.array(texts, pa.large_string())):
            got.append([])
            for t in blocks(part):
                starts, ends, owner = t.pieces(SPACE[t.data[: t.size]])
                found = [[t.data[a:b].tobytes().decode() for a, b, o in zip(starts, ends, owner, strict=True) if o == k] for k in range(len(t.offsets) - 1)]
                got[-1] += found
                assert distinct_words(t, starts, ends, owner).tolist() == [len(set(x)) for x in found]
                capitals = t.per_text(audit_module.CAPITALS[t.data[: t.size]]).tolist()
                assert capitals == [x.count("B") for x in texts[len(got[-1]) - len(found) : len(got[-1])]]
    finally:
        scan.BLOCK = before
    assert got == [[words(x) for x in texts]] * 2


def hashes_of(pieces):
    sizes = np.array([len(k) for k in pieces])
    ends = np.cumsum(sizes)
    return piece_hashes(np.frombuffer(b"".join(pieces) + bytes(8), np.uint8), ends - sizes, ends)


def test_hashes_know_bytes_and_lengths():
    pieces = [b"", b"a", b"a\x00", b"\x00a", b"abcdefgh", b"abcdefghi", b"abcdefgh\x00", b"x" * 1000, b"x" * 1001]
    a, b = hashes_of(pieces), hashes_of(pieces[::-1])
    assert len(set(a.tolist())) == len(pieces) and a.tolist() == b[::-1].tolist()
    data = np.frombuffer(b"abcdefghijk-abcdefghijk-abcdefghijX" + bytes(8), np.uint8)
    at = np.array([0, 0, 0]), np.array([12, 24, 24]), np.array([11, 11, 10])
    assert same_pieces(data, *at).tolist() == [True, False, True]


def test_words_that_share_a_hash_are_counted_apart(monkeypatch):
    monkeypatch.setattr(audit_module, "piece_hashes", lambda data, a, b: piece_hashes(data, a, b) & np.uint64(1))
    texts = ["b a b c a", "", "one two three one", "x x x"]
    (t,) = blocks(pa.array(texts))
    assert distinct_words(t, *t.pieces(SPACE[t.data[: t.size]])).tolist() == [3, 0, 3, 1]


def test_fill_in_middle(spark):
    r = random.Random(2)
    texts = [None, "", " ", "a", "\n\na  b\t", "has <S> inside", "a < b", "ends <", "P> starts", "nul \x00 b", "x" * 300_000, "word " * 60_000]
    texts += ["".join(r.choice(ODD) for _ in range(r.randrange(60))) for _ in range(300)]
    rows = [(None if k % 50 == 49 else k * 7, t, "s") for k, t in enumerate(texts)] + [(7, "the same row", "s")] * 2
    got = fill_in_middle(frame(spark, rows))
    got = got.withColumn("back", restored()).collect()
    want, forms = [], Counter()
    for i, t, _ in rows:
        t = t or ""
        units = re.findall(TOKEN, t)
        assert "".join(units) == t
        h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
        h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted(x % (len(units) + 1) for x in h[:2])
        p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        form = "plain" if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
        out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        forms[form] += 1
        want.append((i, len(units), form, *((None, None) if form == "plain" else (len(p), len(m))), out, t))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and min(forms.values()) > 10
    assert fill_in_middle(frame(spark, [])).count() == 0


def brute_audit(rows, labels):
    fails = []
    for k, (i, t, s) in enumerate(rows):
        t, w = t or "", words(t or "")
        smaller = any(u[0] is not None and (i is None or u[0] < i) and (u[1] or "") == t for u in rows)
        mask = {f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), smaller), strict=True) if bad}
        fails.append((s or "", mask, *(any(x[0] == i and i is not None and x[c] == 1 for x in labels) for c in (1, 2))))
    out = []
    for part in {f[0] for f in fails}:
        mine, shapley, found = [f for f in fails if f[0] == part], Counter(), []
        for order in permutations("ABCDE"):
            for step, c in enumerate(order):
                before = set(order[:step])
                hit = [f for f in mine if c in f[1] and not f[1] & before]
                shapley[c] += len(hit)
                kept = sum(not f[1] & (before | {c}) for f in mine)
                redundant = sum(c in f[1] and bool(f[1] & before) for f in mine)
                found.append((part, "".join(order), step + 1, kept, len(hit), redundant, sum(f[1] == {c} for f in mine), sum(f[2] for f in hit), sum(f[3] for f in hit), c))
        out += [(*f[:-1], shapley[f[-1]]) for f in found]
    return out


def test_filter_audit(spark):
    r = random.Random(4)
    rows = []
    for k in range(120):
        many = [r.choice("abcdefghij") if k % 3 else f"w{r.randrange(10**6)}" for _ in range(r.choice((3, 150, 199, 200, 201)))]
        many[0] = r.choice(("Ab", "XXXXXXXXXXXXXXXXXXXXX", "a#", "é" * 40, "ok"))
        rows.append((k, r.choice((" ", "\n", "\xa0 ")).join(many), r.choice(("hot", "hot", "b", None))))
    rows += [(200 + k, rows[r.randrange(20)][1], "hot") for k in range(60)]
    rows += [(300, None, "b"), (301, "", "hot"), (None, "", "b"), (None, "alone", "b"), (None, "alone", "hot"), (302, "twice", "b"), (302, "twice", None), (303, "A" * 2 + "b" * 98, "b"), (304, "A" * 3 + "b" * 98, "b"), (305, "w" * 200_000, "b")]
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 300, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1), (302, None, 1), (302, 1, None)]
    labels = [(i, None if q is None else int(q), None if t is None else int(t)) for i, q, t in labels]
    frame_of = lambda x: spark.createDataFrame([(*y, "z", "z") for y in x], "doc_id bigint, quality int, toxic int, id string, part string")
    got = filter_audit(frame(spark, rows), frame_of(labels)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_audit(rows, labels))
    assert filter_audit(frame(spark, []), frame_of([])).count() == 0
    assert filter_audit(frame(spark, rows[:3]), frame_of([])).filter("good_lost + toxic_lost > 0").count() == 0


def brute_lines(rows, min_docs, keep):
    key = lambda line: re.sub("[A-Z]+", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for n, (i, t, _) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                holders.setdefault(k, []).append((n, i))
    chosen = {k: (max if keep == "last" else min)((i for _, i in h if i is not None), default=None) for k, h in holders.items() if len(h) >= min_docs}
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in chosen or chosen[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


@pytest.mark.parametrize("bounds", [{}, {"filter_words": 1, "lookup_bytes": 0, "keep": "first"}])
def test_line_dedup(spark, bounds):
    """Also with a full filter that suspects every line, and with lists that are joined."""
    r = random.Random(6)
    lines = [" ".join(r.choice(("Alpha", "béta", "GAMMA", "delta", "É", "ζ")) for _ in range(r.randint(4, 16))) for _ in range(40)]
    rows = []
    for k in range(90):
        mine = [r.choice(("", " ", "\t\x0b")) + (x if r.random() < 0.6 else x.lower().replace("É".lower(), "É")) + r.choice(("", "\r", " ")) for x in r.choices(lines, k=r.randrange(12))]
        rows.append((k, "\n".join([*mine, f"only in {k}" + "." * 50][:: r.choice((1, -1))]), "s"))
    hot = "a line that a third of all rows hold, in any case"
    rows += [(500 + k, hot.upper() + "\nrest", "s") for k in range(45)]
    rows += [(1000, None, "s"), (1001, "", "s"), (1002, "\n\n", "s"), (None, hot, "s"), (None, hot + "\n" + hot, "s"), (1003, hot, "s"), (1003, hot + "\n", "s"), (1004, "x" * 200_000, "s"), (1005, "é" * 39 + "\n" + "é" * 40, "s")]
    rows += [(1010 + k, "é" * 39 + " \n" + "é" * 40, "s") for k in range(5)]
    rows += [(None, "held by rows without an id alone, five of them", "s")] * 5
    got = dedup_lines(frame(spark, rows), **bounds)
    want = brute_lines(rows, 5, bounds.get("keep", "last"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and sum(w[2] for w in want) > 100
    assert dedup_lines(frame(spark, []), **bounds).count() == 0


def test_filters_miss_no_repeat():
    r = np.random.default_rng(1)
    once, often = r.integers(0, 1 << 63, 5000, np.int64).view(np.uint64), r.integers(0, 1 << 63, 500, np.int64).view(np.uint64)
    f = TwoFilters(2048)
    f.add(np.concatenate([once, often[:250]]), np.zeros(5250, bool))
    f.add(often[:250], np.zeros(250, bool))
    f.add(often[250:], np.ones(250, bool))
    assert may_repeat(f.twice, often).all() and may_repeat(f.twice, once).mean() < 0.05
    folded = f.twice[:1024] | f.twice[1024:]
    assert may_repeat(folded, often).all()
