"""Byte-level byte-pair encoding by replaying the merges over all distinct words of a block at once.

The distinct words of a block of texts lie one after another in one array of tokens, at first one for
each byte. An inverted index has, for each rank, the positions whose pair has that rank. Ranks are
taken from the least on, and each is applied at all its positions together, from the left within a
word; only the pairs of the merged positions and of their left neighbours are looked up anew and enter the
index. A word's own encoder would do the same merges in the same order, as long as no merge makes a
pair of a lower rank than its own; a word in which one does is taken out and encoded by itself.

Texts are cut at single spaces into units before the pattern is applied, so that a unit which occurs often
is matched and encoded once a task. Where a space is followed by white space or by nothing, the pattern sees
the whole text.
"""

from __future__ import annotations

import base64
import gc
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

#: Bytes of encodings that a task keeps, in each of two generations.
KEEP_BYTES = 96 << 20
#: Texts that are replayed together, and their bytes.
ROWS, SIZE = 4096, 8 << 20
#: Ids that are decoded at a time.
DECODED = 1 << 18
#: Rank of a pair that does not merge.
NONE = np.iinfo(np.int32).max
#: White space of the pattern, as Unicode has it; the regex module's own class has U+001C to U+001F besides.
SPACE = r"\t-\r \x85\xa0  -     　"
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_MARKS = frozenset(".,;:!?")
_OPEN_SPACE = regex.compile(rf" (?:[{SPACE}]|\Z)")


class MergeReplay:
    """Ranks of one vocabulary file, with the replay over words."""

    def __init__(self, content: str) -> None:
        self.ranks: dict[bytes, int] = {base64.b64decode(a): int(b) for a, b in map(str.split, filter(None, content.splitlines()))}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pool = np.cumsum([0, *map(len, self.tokens)])
        self.pool, self.at, self.length = np.frombuffer(b"".join(self.tokens), np.uint8), pool[:-1].astype(np.int32), np.diff(pool).astype(np.int32)
        pairs = sorted((l * size + r, rank) for token, rank in self.ranks.items() for i in range(1, len(token)) if (l := self.ranks.get(token[:i])) is not None and (r := self.ranks.get(token[i:])) is not None)
        self.size = size
        self.pair = np.array([p for p, _ in pairs], np.int64)
        self.rank = np.array([r for _, r in pairs], np.int32)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens; NONE where they do not merge, as beside a word's end (token -1)."""
        if not len(self.pair):
            return np.full(len(left), NONE, np.int32)
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (left >= 0) & (right >= 0), self.rank[at], NONE)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit integers."""
        if not words:
            return []
        # a gap before each word and one at the end, so that no pair spans two words
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size + 1) - size
        n = int(start[-1] + size[-1]) + 1
        token = np.full(n, -1, np.int32)
        inside = np.ones(n, bool)
        inside[start - 1] = inside[n - 1] = False
        token[inside] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[-1], before[0] = n - 1, 0
        rank = np.full(n, NONE, np.int32)
        rank[:-1] = self.rank_of(token[:-1], token[1:])

        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(at: np.ndarray) -> None:
            of = rank[at]
            order = np.argsort(of, kind="stable")
            at, of = at[order], of[order]
            cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
            for r, places in zip(of[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True):
                if r in index:
                    index[r].append(places)
                else:
                    index[r] = [places]
                    heapq.heappush(queue, r)

        odd: set[int] = set()
        at = np.flatnonzero(rank != NONE)
        if len(at):
            enter(at)
        while queue:
            r = heapq.heappop(queue)
            found = index.pop(r)
            at = found[0] if len(found) == 1 else np.concatenate(found)
            at = np.sort(at[rank[at] == r])
            if not len(at):
                continue
            if len(at) > 1:
                # of places that overlap, every other one from the left
                touches = after[at[:-1]] == at[1:]
                if touches.any():
                    head = np.r_[True, ~touches]
                    places = np.arange(len(at))
                    at = at[(places - np.maximum.accumulate(np.where(head, places, 0))) % 2 == 0]
            right = after[at]
            behind = after[right]
            token[at] = r
            token[right] = -1
            inside[right] = False
            rank[right] = NONE
            after[at] = behind
            before[behind] = at
            left = before[at]
            fresh = token[left] >= 0
            fresh[1:] &= left[1:] != at[:-1]
            near = np.concatenate([at, left[fresh]])
            now = self.rank_of(token[near], token[after[near]])
            rank[near] = now
            low = now < r
            if low.any():
                # a word's own encoder would take such a pair at once: those words leave the replay
                for w in np.unique(np.searchsorted(start, near[low], side="right") - 1).tolist():
                    odd.add(w)
                    rank[start[w] : start[w] + size[w]] = NONE
                near = near[rank[near] != NONE]
            else:
                near = near[now != NONE]
            if len(near):
                enter(near)
        ids = token[inside].astype("<u4")
        ends = np.cumsum(np.add.reduceat(inside, start, dtype=np.int64)) * 4
        coded = ids.tobytes()
        out = [coded[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        for w in odd:
            out[w] = np.array(self.encode_word(words[w]), "<u4").tobytes()
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of little-endian 32-bit ids."""
        all_ids, out = np.frombuffer(ids, "<u4"), []
        for some in (all_ids[i : i + DECODED] for i in range(0, len(all_ids), DECODED)):
            size = self.length[some]
            behind = np.cumsum(size)
            out.append(self.pool[np.arange(behind[-1]) + np.repeat(self.at[some] - (behind - size), size)].tobytes())
        return b"".join(out)

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one word: the pair of the least rank, the leftmost of several, merges until none is left."""
        n, ranks = len(word), self.ranks
        end = list(range(1, n + 1))  # of the token that starts there
        prior = list(range(-1, n - 1))
        alive = bytearray(b"\1") * n

        def pair(i: int) -> int | None:
            return ranks.get(word[i : end[end[i]]]) if end[i] < n else None

        queue = [(r, i, end[end[i]]) for i in range(n - 1) if (r := pair(i)) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, stop = heapq.heappop(queue)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            alive[end[i]] = 0
            end[i] = stop
            if stop < n:
                prior[stop] = i
            for j in (prior[i], i):
                if j >= 0 and (r := pair(j)) is not None:
                    heapq.heappush(queue, (r, j, end[end[j]]))
        return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def units(text: str) -> list[str]:
    """Parts of the text, cut before single spaces, in each of which the pattern finds what it finds in the whole."""
    if _OPEN_SPACE.search(text):
        return _WORDS.findall(text)
    first, *more = text.split(" ")
    return [first, *[" " + x for x in more]] if first else [" " + x for x in more]


class Encoder:
    """Encodes blocks of texts; keeps encodings of distinct units for later blocks of the task, in two generations of bounded size."""

    def __init__(self, model: MergeReplay, keep_bytes: int = KEEP_BYTES) -> None:
        self.model, self.keep_bytes = model, keep_bytes
        self.held = 0
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, block: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        cut = [units(t) for t in block]
        if self.held > self.keep_bytes:
            self.old, self.kept, self.held = self.kept, {}, 0
        kept, old = self.kept, self.old
        new = set().union(*cut).difference(kept)
        if old:
            again = new.intersection(old)
            kept |= {u: old[u] for u in again}
            new -= again
        parts = {u: matches(u) for u in new}
        words = list({w for ws in parts.values() for w in ws})
        coded = dict(zip(words, self.model.encode_words([w.encode() for w in words]), strict=True))
        for u, ws in parts.items():
            kept[u] = coded[ws[0]] if len(ws) == 1 else b"".join([coded[w] for w in ws])
        self.held += 250 * len(new) + sum(len(u) for u in new if len(u) > 32)
        get = kept.__getitem__
        return [b"".join(list(map(get, us))) for us in cut]


def matches(unit: str) -> list[str]:
    """The pattern's matches in a unit; letters only, or with one mark behind them, need no search."""
    bare = unit[1:] if unit[:1] == " " else unit
    if bare.isalpha():
        return [unit]
    if unit[-1:] in _MARKS and bare[:-1].isalpha():
        return [unit[:-1], unit[-1]]
    return _WORDS.findall(unit)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit) and the decoded bytes of each row of ``docs``.

    ``path`` is a file of base64 tokens and ranks, in which every byte is a token. Null and empty texts
    have no tokens and decode to nothing. Repeated rows and rows without a doc_id are encoded each;
    other columns are ignored; an empty table gives none. Texts may be of any length: a text of more than a block's
    size is a block of its own, in the memory of a small multiple of its length. Rows keep their partitions:
    nothing is shuffled, and a lost task is computed again from its own rows.
    """
    with open(path, encoding="utf-8") as f:
        # a few MB whatever the input; made once, so that tasks need not build it
        model: Broadcast = docs.sparkSession.sparkContext.broadcast(MergeReplay(f.read()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # blocks make many strings and no cycles; the collector would walk them again and again
        try:
            encoder = Encoder(model.value)
            for batch in slices(batches, ROWS, SIZE):
                ids = encoder.encode(texts(batch))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(encoder.model.decode, ids), pa.binary())],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )
        finally:
            gc.enable()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
