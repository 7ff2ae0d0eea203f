"""Token counts of a byte-level BPE by rank-synchronous array merging.

Pre-tokens of a batch become one ragged numpy array of symbols. In each round every
sequence applies its own lowest-rank pair at all its places at once; ranks are looked
up again only beside the merged places. The symbols that survive are the tokens.

Defined results: a null or empty text has 0 bytes and 0 tokens; the strings of special
tokens inside a text count as that one token, as the library's default has it; repeated
rows each give their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewindow.llm.common import PairTable, byte_alphabet, ragged, small_batches, text_or_empty

#: Fixed value: how byte-level BPE splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII and Latin characters and common punctuation alone, whose classes can be listed.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
PLAIN_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+"
OTHER = r"[^\t\n\r\x20-\x7eªµºÀ-ɏ‐-‧]"
#: Counts that a Python worker remembers at most; then it forgets all and starts again.
MEMO = 300_000
NONE = np.int32(2**31 - 1)


class RankMerger:
    """Counts the tokens of pre-tokens under the merges of a tokenizer file."""

    def __init__(self, tokenizer: str):
        doc = json.loads(tokenizer)
        vocab = doc["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in doc["model"]["merges"]]
        first = np.array([vocab[a] for a, _ in merges], np.int64)
        second = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.ranks = PairTable(first, second, np.arange(len(merges)))
        self.of_byte = np.array([vocab[c] for c in byte_alphabet()], np.int32)
        self.specials = [t["content"] for t in doc["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.any_split, self.plain_split = regex.compile(SPLIT).findall, re.compile(PLAIN_SPLIT).findall
        self.other = re.compile(OTHER).search
        self.memo: dict[str, int] = {}

    def rank(self, sym: np.ndarray, seq: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that start at the given places; NONE where there is none."""
        out = np.full(len(at), NONE, np.int32)
        ok = at < len(sym) - 1
        ok[ok] = seq[at[ok]] == seq[at[ok] + 1]
        p = at[ok]
        r = self.ranks.get(sym[p], sym[p + 1])
        out[ok] = np.where(r < 0, NONE, r)
        return out

    def merged_lengths(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token (given as bytes)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        counts = lengths.copy()
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        _, seq = ragged(lengths)
        rank = self.rank(sym, seq, np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            sizes = np.diff(np.r_[starts, len(seq)])
            low = np.minimum.reduceat(rank, starts)
            counts[seq[starts]] = sizes
            going = low != NONE
            if not going.all():  # finished sequences leave
                stay = np.repeat(going, sizes)
                sym, seq, rank, low, sizes = sym[stay], seq[stay], rank[stay], low[going], sizes[going]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, sizes))
            # of neighbouring places of one run (a a a), every other one merges
            fresh = np.r_[True, np.diff(hit) != 1]
            run = np.flatnonzero(fresh)
            hit = hit[(np.arange(len(hit)) - run[np.cumsum(fresh) - 1]) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            hit = hit - np.arange(len(hit))
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            near = np.r_[hit, hit[hit > 0] - 1]
            rank[near] = self.rank(sym, seq, near)
        return counts

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        return self.any_split(text) if self.other(text) else self.plain_split(text)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        parts, extra = [], []
        for t in texts:
            special = self.cut.findall(t) if self.cut and any(s in t for s in self.specials) else []
            extra.append(len(special))
            parts.append([w for s in self.cut.split(t) for w in self.split(s)] if special else self.split(t))
        memo = self.memo
        new = list(set().union(*parts).difference(memo))
        if new:
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = list(set().union(*parts))
            memo.update(zip(new, self.merged_lengths([w.encode() for w in new]).tolist(), strict=True))
        return [e + sum(map(memo.__getitem__, p)) for e, p in zip(extra, parts, strict=True)]


_mergers: dict[int, RankMerger] = {}


def merger(tokenizer: str) -> RankMerger:
    """One merger for each Python worker and file."""
    key = hash(tokenizer)
    if key not in _mergers:
        _mergers[key] = RankMerger(tokenizer)
    return _mergers[key]


def with_token_counts(rows: DataFrame, tokenizer: str, *, text: str = "t", name: str = "n_tokens") -> DataFrame:
    """``rows`` with the tokens of ``text``, which no null may be in, in place of that column. ``tokenizer``: a tokenizer file's content."""
    spark = rows.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(shared.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.counts(texts), pa.int64())], ["row", "n"])

    others = [c for c in rows.columns if c != text]
    packed = rows.select(F.struct(*others).alias("row"), F.col(text).alias("t"))
    out = packed.mapInArrow(count, f"row {packed.schema['row'].dataType.simpleString()}, n bigint")
    return out.select(*(F.col(f"row.{c}").alias(c) for c in others), F.col("n").alias(name))


def token_counts(docs: DataFrame, tokenizer: str, *, text: str = "text", key: str = "doc_id", limit: int = 1024) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` of every row. ``tokenizer``: a tokenizer file's content."""
    rows = docs.select(F.col(key).alias("k"), F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"), text_or_empty(text).alias("t"))
    out = with_token_counts(rows, tokenizer)
    return out.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
