"""Byte-level BPE encoding of a corpus by a prefix-sharing trie.

The encoding of a byte string by BPE is fixed by the last token of each of its prefixes: the last token of a
prefix is the one suffix token that BPE would not merge across its left border with the last token before it.
So the distinct words of a task's texts go into one trie, in sorted order (a depth-first traversal); each node
keeps the last token of its prefix and the node before that token, computed once for all words that share the
prefix. A word's ids are read by following these links back. Texts are cut into words by the vocabulary's
pattern; there is no shuffle, a text never leaves its task, and a task's trie is dropped when it gets too
large, which changes nothing in the result.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public tokenizers' files; a parameter of every function that needs one.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# The pattern that cuts a text into words before byte-level BPE.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A task's trie is started anew beyond so many nodes (about 150 bytes each).
TRIE_NODES = 1_000_000
#: Texts are handled in slices of about so many characters.
SLICE_CHARS = 2_000_000


class Vocabulary:
    """Tokens by bytes, and how each was merged from two others."""

    def __init__(self, content: bytes) -> None:
        self.ranks: dict[bytes, int] = {}
        for line in content.split(b"\n"):
            if line:
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.bytes = {r: t for t, r in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        size = max(self.bytes) + 1
        self.left, self.right = list(range(size)), list(range(size))
        self.pairs: dict[tuple[int, int], int] = {}
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self._merge(token, rank)
                if len(parts) == 2:
                    a, b = self.ranks[parts[0]], self.ranks[parts[1]]
                    self.left[rank], self.right[rank] = a, b
                    self.pairs[a, b] = rank
        self.fits: dict[tuple[int, int], bool] = {}

    def _merge(self, token: bytes, below: int) -> list[bytes]:
        """Plain BPE over one token with the merges that are older than itself."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            ranked = [(self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranked)
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def adjoin(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens a and b side by side: no merge older than those that made them crosses the border."""
        known = self.fits.get((a, b))
        if known is not None:
            return known
        x, y, limit = a, b, 1 << 60
        while True:
            merged = self.pairs.get((x, y))
            if merged is not None and merged < limit:
                ok = False
                break
            # take back the younger of the two last merges at the border
            if x > y:
                undo_x = self.right[x] != x
                if not undo_x and self.left[y] == y:
                    ok = True
                    break
            else:
                undo_x = self.left[y] == y
                if undo_x and self.right[x] == x:
                    ok = True
                    break
            if undo_x:
                limit, x = x, self.right[x]
            else:
                limit, y = y + 1, self.left[y]
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[a, b] = ok
        return ok


class PrefixTrie:
    """Last token and the node before it, for each prefix of the words inserted so far."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.token, self.before = [-1], [0]

    def encode(self, word: bytes) -> list[int]:
        child, token, before, ranks, adjoin = self.child, self.token, self.before, self.v.ranks, self.v.adjoin
        node, path = 0, [0]
        for i, byte in enumerate(word):
            key = node << 8 | byte
            nxt = child.get(key)
            if nxt is None:
                nxt = child[key] = len(token)
                for n in range(min(i + 1, self.v.longest), 0, -1):
                    t = ranks.get(word[i + 1 - n : i + 1])
                    if t is not None:
                        prev = path[i + 1 - n]
                        if prev == 0 or adjoin(token[prev], t):
                            token.append(t)
                            before.append(prev)
                            break
            node = nxt
            path.append(node)
        out = []
        while node:
            out.append(token[node])
            node = before[node]
        out.reverse()
        return out


class Encoder:
    def __init__(self, content: bytes, pattern: str = WORD) -> None:
        self.vocabulary = Vocabulary(content)
        self.words = regex.compile(pattern).findall
        self.limit = TRIE_NODES
        self._fresh()

    def _fresh(self) -> None:
        self.trie = PrefixTrie(self.vocabulary)
        self.known: dict[str, list[int]] = {}

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.words(t) if t else [] for t in texts]
        if len(self.trie.token) > self.limit:
            self._fresh()
        known, encode = self.known, self.trie.encode
        for w in sorted(set(chain.from_iterable(cut)) - known.keys()):
            known[w] = encode(w.encode("utf-8", "surrogatepass"))
        return [list(chain.from_iterable(map(known.__getitem__, words))) for words in cut]


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def _slices(texts: list) -> Iterator[list]:
    held, chars = [], 0
    for t in texts:
        held.append(t)
        chars += len(t or "")
        if chars >= SLICE_CHARS:
            yield held
            held, chars = [], 0
    yield held


def _per_text(df: DataFrame, key: str, text: str, result: str, of: Callable, folder: str, vocabulary: str) -> DataFrame:
    with open(f"{folder}/{vocabulary}", "rb") as f:
        content = f.read()
    shipped = df.sparkSession.sparkContext.broadcast(content)  # one vocabulary file, under 1 MB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = (hash(shipped.value), WORD)
        enc = _ENCODERS.get(name)
        if enc is None:
            enc = _ENCODERS[name] = Encoder(shipped.value)
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["text"]]
            out = [of(ids) for part in _slices(texts) for ids in enc.encode_batch(part)]
            yield pd.DataFrame({"key": b["key"], "out": pd.Series(out, dtype="object")})

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"key {dict(df.dtypes)[key]}, out {result}")


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens.

    Null and empty texts give an empty list; the strings of special tokens inside a text are ordinary text.
    Repeated rows each give a row; other columns are not read.
    """
    return _per_text(df, key, text, "array<int>", lambda ids: ids, folder, vocabulary).select(F.col("key").alias(key), F.col("out").alias("ids"))


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of each text; 0 for null and empty ones."""
    return _per_text(df, key, text, "bigint", len, folder, vocabulary).select(F.col("key").alias(key), F.col("out").alias("n_tokens"))
