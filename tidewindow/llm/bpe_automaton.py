"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens. It starts with one state in which every base symbol loops;
then each merge (u, v -> w), in rank order, applies one merge gadget: the state reached
by u loses its arc v (it is split off first where other tokens share it), and every
state with an arc u gets an arc w to the state reached by v. What it then accepts are
exactly the canonical token sequences. A word is encoded by table-driven transitions:
of the tokens that end at a position, one alone has an arc from the state in which the
rest of the prefix ends. Decoding emits the arc labels.

Defined results: a null or empty text has no tokens, the hash of no bytes and decodes to
the empty string; special tokens inside a text are single ids; repeated rows each give
their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from tidewindow.llm.common import PairTable, byte_alphabet, ragged, released, small_batches, text_or_empty

#: Fixed value: the words that the tokenizer keeps; what lies between is dropped.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters whose classes differ between versions of Unicode; a text with one is split by the library's own splitter.
UNUSUAL = r"[^\x00-\u052f\u2010-\u2027\u20ac]"
#: The library's own steps before splitting, for such texts.
NORMAL = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
#: Encoded words that a Python worker remembers at most; then it forgets all.
MEMO = 200_000
#: Symbols of words that are encoded together.
BLOCK = 400_000


class TokenAutomaton:
    """The deterministic automaton of a merge list and the tables to run it."""

    def __init__(self, tokenizer: str):
        doc = json.loads(tokenizer)
        vocab: dict[str, int] = doc["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in doc["model"]["merges"]]
        self.suffix = doc["model"].get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in doc["added_tokens"]}
        self.labels = {i: t for t, i in {**vocab, **self.specials}.items()}
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + self.suffix] for c in letters], np.int32)
        base = sorted({*self.inner.tolist(), *self.final.tolist()})
        self._compile(base, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], max(vocab.values()) + 1)

    def _compile(self, base: list[int], merges: list[tuple[int, int, int]], n_tokens: int) -> None:
        arcs = np.zeros((8192, n_tokens // 8 + 1), np.uint8)  # arcs[state] has a bit for each token
        for t in base:
            arcs[0, t >> 3] |= np.uint8(1 << (t & 7))
        state = np.zeros(n_tokens, np.int32)  # the state that a token's arcs lead to
        sharers = [len(base) + 1]  # tokens that lead to a state; the start counts too
        spelled: dict[int, tuple[int, ...]] = {t: (t,) for t in base}
        for u, v, w in merges:
            s, after = int(state[u]), int(state[v])
            if u not in spelled or v not in spelled or not arcs[s, v >> 3] >> (v & 7) & 1:
                continue  # v never follows u: the merge cannot apply
            if sharers[s] > 1 or u == v:
                n = len(sharers)
                if n == len(arcs):
                    arcs = np.concatenate([arcs, np.zeros_like(arcs[: n // 2])])
                arcs[n] = arcs[s]
                sharers[s] -= 1
                sharers.append(1)
                state[u] = s = n
            arcs[s, v >> 3] &= np.uint8(255 ^ (1 << (v & 7)))
            n = len(sharers)
            column = arcs[:n, u >> 3] >> np.uint8(u & 7) & np.uint8(1)
            arcs[:n, w >> 3] |= column << np.uint8(w & 7)
            state[w] = after
            sharers[after] += 1
            spelled[w] = spelled[u] + spelled[v]
        self.arcs, self.state = np.ascontiguousarray(arcs[: len(sharers)]), state
        children: dict[tuple[int, int], int] = {}
        token_of = [-1]
        for token, symbols in spelled.items():
            node = 0
            for x in symbols:
                child = children.get((node, x))
                if child is None:
                    child = children[node, x] = len(token_of)
                    token_of.append(-1)
                node = child
            token_of[node] = token
        self.token_of = np.array(token_of, np.int32)
        pairs = np.array(list(children), np.int64).reshape(-1, 2)
        self.steps = PairTable(pairs[:, 0], pairs[:, 1], np.fromiter(children.values(), np.int64))

    def allows(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        return (self.arcs[state, token >> 3] >> (token & 7).astype(np.uint8) & 1).astype(bool)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The token ids of each word (its bytes, at least one)."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (size == 0 or size + len(words[end]) <= BLOCK):
                size += len(words[end])
                end += 1
            out += self._encode_block(words[at:end])
            at = end
        return out

    def _encode_block(self, words: list[bytes]) -> list[np.ndarray]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts, word = ragged(lengths)
        data = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[data]
        ends = starts + lengths - 1
        sym[ends] = self.final[data[ends]]
        # every token that lies somewhere in a word: where it starts, where it ends
        begin = np.arange(len(sym))
        node = np.zeros(len(sym), np.int32)
        last = ends[word]
        here = begin
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(begin):
            node = self.steps.get(node, sym[here])
            alive = node >= 0
            begin, here, node = begin[alive], here[alive], node[alive]
            token = self.token_of[node]
            full = token >= 0
            found.append((begin[full], here[full], token[full]))
            more = here < last[begin]
            begin, here, node = begin[more], here[more] + 1, node[more]
        begin, end, token = (np.concatenate(x) for x in zip(*found, strict=True))
        # positions in words, in ascending order of where tokens end
        depth = end - starts[word[end]]
        order = np.argsort(depth, kind="stable")
        begin, end, token = begin[order], end[order], token[order]
        bounds = np.searchsorted(depth[order], np.arange(int(lengths.max()) + 1))
        # shifted by the word number, place p + word is the state after p symbols of it
        reached = np.full(len(sym) + len(words), -1, np.int32)
        reached[starts + np.arange(len(words))] = 0
        came = np.zeros(len(sym), np.int64)
        label = np.full(len(sym), -1, np.int32)
        for lo, hi in zip(bounds[:-1].tolist(), [*bounds[1:-1].tolist(), len(order)], strict=True):
            b, e, t = begin[lo:hi], end[lo:hi], token[lo:hi]
            w = word[b]
            q = reached[b + w]
            ok = (q >= 0) & self.allows(q, t)
            b, e, t, w = b[ok], e[ok], t[ok], w[ok]
            reached[e + 1 + w] = self.state[t]
            came[e], label[e] = b, t
        # back along the path of each word
        at, ids, of = ends.copy(), [], []
        live = np.arange(len(words))
        while len(live):
            p = at[live]
            if (label[p] < 0).any():
                raise ValueError("a word has no path through the automaton")
            ids.append(label[p])
            of.append(live)
            at[live] = came[p] - 1
            live = live[came[p] > starts[live]]
        flat_of = np.concatenate(of[::-1])
        order = np.argsort(flat_of, kind="stable")
        flat = np.concatenate(ids[::-1])[order].astype("<u4")
        return np.split(flat, np.cumsum(np.bincount(flat_of, minlength=len(words)))[:-1])


class WordBpe:
    """Encodes and decodes texts with a :class:`TokenAutomaton`."""

    def __init__(self, tokenizer: str):
        self.automaton = TokenAutomaton(tokenizer)
        self.words = regex.compile(WORDS).findall
        self.unusual = regex.compile(UNUSUAL).search
        self.normal = NORMAL
        self.library_split = pre_tokenizers.Split(Regex(WORDS), "removed", invert=True)
        self.blank = regex.compile(r"\s+")
        specials = self.automaton.specials
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")")
        self.memo: dict[str, bytes] = {}

    def _pieces(self, text: str) -> list[str]:
        if self.unusual(text):
            return [w for w, _ in self.library_split.pre_tokenize_str(self.normal.normalize_str(text))]
        # per character, as the tokenizer does: a capital sigma never becomes a final one
        return self.words(self.blank.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower())

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        specials = self.automaton.specials
        parts = []
        for t in texts:
            if any(s in t for s in specials):
                parts.append([w for s in self.cut.split(t) for w in ([s] if s in specials else self._pieces(s))])
            else:
                parts.append(self._pieces(t))
        memo = self.memo
        new = {w for p in parts for w in p if w not in memo}
        if new:
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = {w for p in parts for w in p}
            todo = [w for w in new if w not in specials]
            memo.update(zip(todo, (x.tobytes() for x in self.automaton.encode_words([w.encode() for w in todo])), strict=True))
            memo.update((s, np.array([i], "<u4").tobytes()) for s, i in specials.items())
        return [b"".join(map(memo.__getitem__, p)) for p in parts]

    def decode(self, ids: bytes) -> str:
        """The arc labels in turn, one space between them."""
        return " ".join(map(self.automaton.labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_coders: dict[int, WordBpe] = {}


def coder(tokenizer: str) -> WordBpe:
    """One coder for each Python worker and file."""
    key = hash(tokenizer)
    if key not in _coders:
        _coders[key] = WordBpe(tokenizer)
    return _coders[key]


def bpe_encode(docs: DataFrame, tokenizer: str, *, text: str = "text", out: str = "ids") -> DataFrame:
    """All rows and columns of ``docs`` and ``out``: the ids as little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(tokenizer)

    @F.pandas_udf("binary")
    def ids(texts):
        import pandas as pd

        return pd.Series(coder(shared.value).encode(texts.tolist()), dtype=object)

    return docs.withColumn(out, ids(text_or_empty(text)))


def bpe_round_trip(docs: DataFrame, tokenizer: str, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of every row: encodes each text, then decodes its ids."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(tokenizer)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(shared.value)
        for b in batches:
            ids = c.encode(b.column(1).to_pylist())
            sha = [hashlib.sha256(x).hexdigest() for x in ids]
            back = [hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(sha), pa.array(back)], ["k", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
    return rows.mapInArrow(lambda b: released(digest(b)), f"k {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("k", key)
