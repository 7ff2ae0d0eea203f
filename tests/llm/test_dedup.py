"""Exact and near deduplication against brute force."""

import hashlib
import os
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewindow.llm import near_dup
from tidewindow.llm.components import components
from tidewindow.llm.exact_dedup import CuckooIndex, exact_dedup
from tidewindow.llm.near_dup import _Chunk, near_duplicates, shingle_sets, signatures

DOCS = "doc_id bigint, text string, keep_id string, component_id string, id string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], DOCS)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 40)), max_size=300))
def test_index_is_a_dictionary(steps):
    index, model = CuckooIndex(4), {}
    for put, k in steps:
        digest = hashlib.sha256(bytes([k])).digest()
        if put:
            assert index.put(digest, k) == (k not in model)
            model[k] = True
        else:
            assert index.delete(digest) == bool(model.pop(k, False))
        assert index.live == len(model) == sum(map(len, index.buckets))
    assert {v for _, v in index.items()} == set(model)


def test_index_grows_and_keeps_all():
    keys = [os.urandom(32) for _ in range(20_000)]
    index = CuckooIndex()
    assert all(index.put(k, i) for i, k in enumerate(keys)) and index.resizes > 3
    assert all(index.get(k) == i for i, k in enumerate(keys)) and index.get(os.urandom(32)) is None


def test_exact(spark):
    rows = [(5, "a  b"), (2, "a b"), (9, "a\t\nb"), (1, " a b"), (3, None), (4, ""), (4, ""), (7, "a\xa0b"), (None, "solo"), (None, "a b"), (8, "x" * 100_000)]
    got = exact_dedup(frame(spark, rows)).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    want = []
    for i, t in rows:
        group = [j for j, u in rows if norm(u) == norm(t)]
        keep = min((j for j in group if j is not None), default=None)
        want.append((i, keep, len(group), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert exact_dedup(frame(spark, [])).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(60)] + [(100 + r.randrange(50), 100 + r.randrange(50)) for _ in range(40)] + [(7, 7), (3, 4)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert {n: find(n) for n in list(parent) if find(n) != n} == got
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """The component of each id, by a loop over all pairs of ids."""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    ids, root = sorted(sets), {i: i for i in sets}
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]) and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = {i: lo if v == hi else v for i, v in root.items()}
    return root


def test_near(spark):
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 7))) for _ in range(300)]
    rows, common = [], " ".join(r.choice(vocabulary) for _ in range(60))
    for k in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice((30, 60, 120)))]
        for _ in range(r.randint(1, 14)):  # copies with edits about the threshold, all sharing one passage
            words = list(base)
            for _ in range(r.randint(0, 5)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append((len(rows) * 3 % 1009, " ".join(words) + (" " + common if k % 3 == 0 else "")))
    rows += [(2000, ""), (2001, None), (2002, " \n"), (2003, "One two"), (2004, "one  TWO"), (2005, "one two three"), (2006, "É a b c d"), (2007, "é a b c d"), (2008, "w " * 5000)]
    got = {x["doc_id"]: x for x in near_duplicates(frame(spark, rows)).collect()}
    want = brute(rows)
    assert {i: x["component_id"] for i, x in got.items()} == want
    assert all(x["n_shingles"] == len(shingles(t)) and x["kept"] == (want[i] == i) for i, t in rows for x in [got[i]])


def test_near_odd_rows(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "x y z"), (2, "x y z"), (9, "a b c d e f"), (4, "q"), (4, "q"), (4, None), (7, "q"), (None, None)]
    got = near_duplicates(frame(spark, rows)).collect()
    want = [(i, len(shingles(t)), None if i is None else 2, i in (None, 2)) for i, t in rows if t is not None]
    want += [(4, 0, 4, True), (None, 0, None, True)]  # without words a row is linked with nothing
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert near_duplicates(frame(spark, [])).count() == 0


def test_near_hot_group(spark, monkeypatch):
    """Hundreds of edits of one text, about the threshold, in one bucket: several rounds of few leaders lose no link."""
    for name, value in (("LEADERS", 3), ("MOST", 40), ("CHUNK", 16), ("HELD", 4000)):
        monkeypatch.setattr(near_dup, name, value)
    r = random.Random(5)
    base = [f"w{r.randrange(400)}" for _ in range(140)]
    rows = []
    for k in range(260):
        words = list(base)
        for _ in range(r.choice((2, 3, 4, 5, 6, 7))):
            at = r.randrange(len(words))
            words[at : at + r.choice((0, 1, 1))] = [f"v{r.randrange(30)}"]
        rows.append((k, " ".join(words)))
    got = {x["doc_id"]: x["component_id"] for x in near_duplicates(frame(spark, rows)).collect()}
    want = brute(rows)
    assert got == want and 20 < len(set(want.values())) < 200


def test_near_reads_whole_texts_once(spark, monkeypatch):
    """A first and a later round share one join with the texts."""
    calls, texts_of = [], near_dup._texts_of
    monkeypatch.setattr(near_dup, "_texts_of", lambda *some: calls.append(1) or texts_of(*some))
    r = random.Random(5)
    base = [f"w{r.randrange(400)}" for _ in range(140)]
    rows = [(k, " ".join(w if r.random() > 0.03 else f"v{r.randrange(30)}" for w in base)) for k in range(60)]
    got = {x["doc_id"]: x["component_id"] for x in near_duplicates(frame(spark, rows)).collect()}
    assert got == brute(rows) and len(calls) == 1


def test_chunk_of_leaders_reports_joins_only():
    """A chunk against a loop over all pairs: the same components from no more links than joins."""
    texts = [" ".join(f"w{i + j}" for j in range(100)) for i in range(0, 60, 3)]
    sets = shingle_sets(texts)
    packed = signatures(sets)[0].view(np.uint64)
    c, n = np.arange(len(sets)), np.array([len(s) for s in sets])
    held = _Chunk()
    for part in (slice(0, 7), slice(7, 12)):
        held.lead(c[part], n[part], packed[part], texts[part])
    links = [x for part in (slice(0, 5), slice(5, 20)) for x in held.links(c[part], n[part], packed[part], texts[part])]
    jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    root = list(range(len(sets)))
    for i in range(12):
        for j in range(len(sets)):
            if jaccard(sets[i], sets[j]) >= 0.75:
                root = [min(root[i], root[j]) if v in (root[i], root[j]) else v for v in root]
    mine = list(range(len(sets)))
    for i, j in links:
        assert mine[i] != mine[j]
        mine = [min(mine[i], mine[j]) if v in (mine[i], mine[j]) else v for v in mine]
    assert mine == root
