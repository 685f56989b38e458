"""Byte-level BPE by speculation: greedy longest matches are proposed for a
word, all adjacent pairs are tested at once, and only words with a failing
pair are merged exactly.

Two tokens may stand side by side if merging their joined bytes gives the same
two tokens.  While a token is built, its last piece runs through the token's
right spine and its first piece through the left spine.  As every merge ranks
after those that made its parts, a merge across the border happens if and only
if some right-spine piece and left-spine piece have a merge that ranks before
the merges which absorb them (at equal rank the leftmost pair goes first).
A row of tokens is the exact result if each is stable on its own and each
adjacent pair passes.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import python_stages, text_or_empty
from .encode import _byte_words

# The byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS = 400_000   # about 120 MB a worker
NEVER = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file:
    printable Latin-1 bytes stand for themselves, the others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class SpeculativeBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("only byte-level BPE files without a normalizer are supported")
        letters, model = byte_letters(), spec["model"]
        vocab = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = token
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.single_ids = np.asarray(self.single, np.int64)
        merge: dict[tuple[int, int], int] = {}
        self.whole_ids = np.empty(len(model["merges"]), np.int64)
        left, right = np.full(size, -1), np.full(size, -1)
        made = np.full(size, -1, np.int64)
        for rank, m in enumerate(model["merges"]):
            a, b = (vocab[bytes(letters[c] for c in part)] for part in (m if isinstance(m, list) else m.split(" ")))
            whole = vocab[self.bytes_of[a] + self.bytes_of[b]]
            merge[a, b] = rank
            self.whole_ids[rank] = whole
            if made[whole] < 0:
                made[whole], left[whole], right[whole] = rank, a, b
        keys = np.fromiter((a << 32 | b for a, b in merge), np.int64, len(merge))
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.fromiter(merge.values(), np.int64, len(keys))[order]
        self.right_spine = self._spine(right, made)
        self.left_spine = self._spine(left, made)
        # A token is stable if its halves are and no merge between them comes before its own.
        stable = np.ones(size, bool)
        merged = np.flatnonzero(made >= 0)
        own = self._agree(left[merged], right[merged], made[merged])
        for t, ok in sorted(zip(merged.tolist(), own.tolist()), key=lambda x: made[x[0]]):
            stable[t] = ok and stable[left[t]] and stable[right[t]]
        self.greedy = {token: i for token, i in vocab.items() if stable[i]}
        # Length of the longest token by its first four bytes; shorter ones need no entry.
        self.reach: dict[bytes, int] = {}
        for token in self.greedy:
            if len(token) > 3:
                self.reach[token[:4]] = max(len(token), self.reach.get(token[:4], 0))
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.lengths = np.fromiter(map(len, self.bytes_of), np.int64, size)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.decimals = list(map(str, range(size)))
        self.cache: dict[str | int, bytes] = {}

    @staticmethod
    def _spine(part: np.ndarray, made: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Levels of (piece, rank of the merge that absorbs it) by token; the
        token itself is absorbed never."""
        piece, end = np.arange(len(part)), np.full(len(part), NEVER)
        levels = [(piece, end)]
        while True:
            deeper = np.where(piece >= 0, part[piece], -1)
            if not (deeper >= 0).any():
                return levels
            end = np.where(deeper >= 0, made[piece], -1)
            piece = deeper
            levels.append((piece, end))

    def _agree(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge across the border of ``a`` and ``b`` comes first;
        ``before``: the rank at which both are absorbed together."""
        fine = np.ones(len(a), bool)
        for right, right_end in self.right_spine:
            rows = np.flatnonzero(fine & (right[a] >= 0))
            if not len(rows):
                break
            for left, left_end in self.left_spine:
                rows = rows[(left[b[rows]] >= 0) & fine[rows]]
                if not len(rows):
                    break
                rank = self._rank(right[a[rows]], left[b[rows]])
                re, le = right_end[a[rows]], left_end[b[rows]]
                if before is not None:
                    re, le = np.minimum(re, before[rows]), np.minimum(le, before[rows] - 1)
                fine[rows[(rank < re) & (rank <= le) & (rank < NEVER)]] = False
        return fine

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the merges of adjacent pairs; ``NEVER`` without one."""
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def exact(self, word: bytes) -> list[int]:
        return self.exact_all([word])[0]

    def exact_all(self, words: list[bytes]) -> list[list[int]]:
        """Merging by rank, leftmost first, of many words at once: each round
        applies every word's lowest merge wherever it occurs in the word."""
        out: list[list[int]] = [[] for _ in words]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        ids = self.single_ids[np.frombuffer(b"".join(words), np.uint8)]
        # rank[i]: of the pair of places i and i + 1; NEVER at a word's end.
        rank = np.full(len(ids), NEVER)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self._rank(ids[inner], ids[inner + 1])
        while len(ids):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            lengths = np.diff(starts, append=len(ids))
            best = np.minimum.reduceat(rank, starts)
            done = best == NEVER
            if done.any():
                ends = starts + lengths
                for k, i, j in zip(owner[starts[done]].tolist(), starts[done].tolist(), ends[done].tolist()):
                    out[k] = ids[i:j].tolist()
                left = np.repeat(~done, lengths)
                ids, owner, rank = ids[left], owner[left], rank[left]
                best, lengths = best[~done], lengths[~done]
                if not len(ids):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, lengths))
            # Of hits side by side (one token repeated) every other one counts.
            first = np.diff(hits, prepend=-2) != 1
            hits = hits[(hits - np.maximum.accumulate(np.where(first, hits, 0))) % 2 == 0]
            ids[hits] = self.whole_ids[rank[hits]]
            rank[hits] = rank[hits + 1]     # the merged place ends where its right half did
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            at = np.cumsum(keep)[hits] - 1
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            # Pairs with a merged place on either side are new.
            at = np.union1d(at, at[at > 0] - 1)
            at = at[at + 1 < len(ids)]
            at = at[owner[at] == owner[at + 1]]
            rank[at] = self._rank(ids[at], ids[at + 1])
        return out

    def propose(self, word: bytes) -> list[int]:
        ids, at, end, vocab, reach = [], 0, len(word), self.greedy, self.reach
        while at < end:
            stop = min(end, at + reach.get(word[at:at + 4], 3))
            while (t := vocab.get(word[at:stop])) is None:
                stop -= 1
            ids.append(t)
            at = stop
        return ids

    def words(self, words: list[bytes]) -> tuple[list[list[int]], int]:
        """Ids of each word, and how many needed exact merging."""
        proposed = [self.propose(w) for w in words]
        counts = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(words)), counts)
        inside = owner[1:] == owner[:-1] if len(flat) else np.empty(0, bool)
        keys, back = np.unique((flat[:-1] << 32 | flat[1:])[inside], return_inverse=True)
        fine = self._agree(keys >> 32, keys & 0xFFFFFFFF)
        failed = np.unique(owner[:-1][inside][~fine[back]]) if len(flat) else []
        for k, ids in zip(failed, self.exact_all([words[k] for k in failed])):
            proposed[k] = ids
        return proposed, len(failed)

    def _learn(self, new: list[str | int]) -> None:
        """Put pieces (whole words, maybe several, or a special token's id) in the cache."""
        parts = [self.pattern.findall(p) if isinstance(p, str) else () for p in new]
        distinct = list(set().union(*parts))
        rows = self.words([w.encode() for w in distinct])[0]
        ends = np.cumsum([4 * len(r) for r in rows]).tolist()
        raw = np.fromiter(chain.from_iterable(rows), "<u4").tobytes()
        ids = {w: raw[i:j] for w, i, j in zip(distinct, [0, *ends], ends)}
        for p, ws in zip(new, parts):
            self.cache[p] = b"".join([ids[w] for w in ws]) if isinstance(p, str) else np.asarray([p], "<u4").tobytes()

    def _pieces(self, text: str) -> list[str | int]:
        """Pieces between which no word reaches, and special tokens' ids."""
        out, at = [], 0
        for m in self.special_at.finditer(text) if self.special_at else ():
            out += [*self._plain(text[at:m.start()]), self.special[m.group()]]
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if not text:
            return []
        words = _byte_words(text)
        return self.pattern.findall(text) if words is None else words

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bytes]]:
        """(ids, decimal ids joined by commas) of each text."""
        pieces = [self._pieces(t) for t in texts]
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        self._learn([p for p in set().union(*pieces) if p not in cache])
        out = []
        for ps in pieces:
            ids = np.frombuffer(b"".join(map(cache.__getitem__, ps)), "<u4")
            out.append((ids, ",".join(map(self.decimals.__getitem__, ids.tolist())).encode()))
        return out

    def decode(self, ids: np.ndarray) -> str:
        ids = ids.astype(np.int64)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.offsets[ids] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[at].tobytes().decode("utf-8", errors="replace")


_MODELS: dict[str, SpeculativeBPE] = {}


def model(path: str) -> SpeculativeBPE:
    """One model a worker process."""
    if path not in _MODELS:
        _MODELS[path] = SpeculativeBPE(path)
    return _MODELS[path]


def _coded(batches, path: str):
    import pyarrow as pa
    bpe = model(path)
    for batch in batches:
        coded = bpe.encode(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([ids.tobytes() for ids, _ in coded], pa.binary()),
             pa.array([hashlib.sha256(dec).hexdigest() for _, dec in coded], pa.string()),
             pa.array([bpe.decode(ids) for ids, _ in coded], pa.string())],
            names=["doc_id", "ids", "ids_sha256", "decoded"])


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian uint32 bytes), ids_sha256 and decoded text of
    every row.  Null text is empty and has no ids; rows are independent, so
    repeated rows and null ``doc_id`` pass through; other columns are not read."""
    python_stages(docs.sparkSession)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
        lambda it: _coded(it, path), "doc_id long, ids binary, ids_sha256 string, decoded string")
