"""Byte-pair encoding of words by a walk over the trie of distinct words.

For each prefix of a word, the encoding of the prefix ends in one token. That last token is all the
state a trie node needs: the encoding of a prefix is the encoding of the part before its last token,
plus that token. A child's last token is the one vocabulary entry that ends there and may stand
after the last token of the node where it starts. So a prefix that many words share is encoded
once. The distinct words of a batch are walked in sorted order, which visits their trie depth-first
and needs only the path from the root in memory.

Words, white space and letter case follow the vocabulary file: NFC, lower case, words with an end
mark on their last symbol, bytes written as printable characters.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, texts

#: Bytes of encodings that a task keeps, in each of two generations.
KEEP_BYTES = 112 << 20
#: Texts whose words are walked together, and their bytes.
ROWS, SIZE = 1024, 4 << 20
#: Words of more bytes are encoded one by one, without the encodings of their prefixes.
LONG = 64
#: Texts of these characters only need no Unicode normalisation.
_PLAIN = re.compile(r"[^\t-\r\x20-\x7e\xa0-ɏ‐-‧‰-⁞]")
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")


def _byte_alphabet() -> str:
    """The printable character that stands for each byte: itself where printable, else from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return "".join(chr(b if b in shown else next(spare)) for b in range(256))


class TrieBpe:
    """Merges and vocabulary of one tokenizer file, with the walk over words."""

    def __init__(self, content: str) -> None:
        self.content = content
        model = (spec := json.loads(content))["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        self.size = [len(t.removesuffix(self.end)) for t in self.tokens]
        self.order, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merged: dict[tuple[int, int], int] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            l, r, t = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merged[l, r] = t
            if self.order[t] < 0:
                self.order[t], self.left[t], self.right[t] = rank, l, r
        bare = [t.removesuffix(self.end) for t in self.vocab]
        self.heads = {t[:k] for t in bare for k in range(len(t) + 1)}
        self.nodes: dict[str, tuple] = {}
        self.alphabet = _byte_alphabet()
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self._library: Any = None

    def fits(self, l: int, r: int) -> bool:
        """Whether the encoder leaves tokens ``l`` and ``r`` as they are when one follows the other.

        Their merges are undone from the latest to the first. Wherever the two symbols that then
        touch have a merge of their own that comes before the merge just undone, it would have won.
        """
        key = l << 20 | r
        known = self.pairs.get(key)
        if known is None:
            order, bound, known = self.order, 1 << 60, True
            while True:
                t = self.merged.get((l, r))
                if t is not None and order[t] < bound:
                    known = False
                    break
                if order[l] > order[r]:
                    bound = order[l]
                    l = self.right[l]
                elif order[r] >= 0:
                    bound = order[r] + 1  # of equal merges, the left one comes first
                    r = self.left[r]
                else:
                    break
            if len(self.pairs) > 250_000:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def stands(self, t: int) -> bool:
        """Whether the token's own text is encoded as this one token."""
        known = self.whole.get(t)
        if known is None:
            l, r = self.left[t], self.right[t]
            # the parts must come about, and nothing across their border may merge before they meet
            known = l < 0 or (self.stands(l) and self.stands(r) and self._meet(l, r, self.order[t]))
            self.whole[t] = known
        return known

    def _meet(self, l: int, r: int, rank: int) -> bool:
        bound = 1 << 60
        order = self.order
        if self.merged.get((l, r)) is None or order[self.merged[l, r]] != rank:
            return False
        while True:
            if order[l] > order[r]:
                bound = order[l]
                l = self.right[l]
            elif order[r] >= 0:
                bound = order[r] + 1
                r = self.left[r]
            else:
                return True
            t = self.merged.get((l, r))
            if t is not None and order[t] < bound:
                return False

    def _node(self, key: str) -> tuple[str, tuple[tuple[int, int], ...], tuple[tuple[int, int], ...]]:
        """For text that ends in ``key``: its longest end that may begin a token, and the (length,
        token) that end there, longest first, inside a word and as the word's end."""
        state = key
        while state not in self.heads:
            state = state[1:]
        found = [(len(state) - i, self.vocab.get(state[i:]), self.vocab.get(state[i:] + self.end)) for i in range(len(state))]
        node = state, tuple((k, t) for k, t, _ in found if t is not None), tuple((k, t) for k, _, t in found if t is not None)
        if len(self.nodes) > 60_000:
            self.nodes.clear()
        self.nodes[key] = node
        return node

    def encode_words(self, words: Iterable[str], units: list[Any], empty: Any) -> dict[str, Any]:
        """Encodings of distinct words (in the byte alphabet, without the end mark) as sums of token units.

        ``units`` has what stands for each token, strings or bytes; ``empty`` is the sum of none.
        """
        known, whole, fits, stands, nodes, make = self.pairs.get, self.whole.get, self.fits, self.stands, self.nodes.get, self._node
        # of the prefix of each length on the path: last token, place in the vocabulary's heads, encoding
        last, state, coded = [-1] * LONG, [""] * LONG, [empty] * LONG
        out: dict[str, Any] = {}
        before, deep = "", 0
        for w in sorted(words):
            n = len(w)
            if n > LONG:
                out[w] = empty.join([units[t] for t in self._long(w)])
                continue
            d, most = 0, min(deep, n - 1)
            while d < most and w[d] == before[d]:
                d += 1
            now = state[d]
            for d in range(d, n - 1):
                key = now + w[d]
                now, inside, _ = nodes(key) or make(key)
                d += 1
                state[d] = now
                for k, t in inside:
                    if k == d:
                        if whole(t) or stands(t):
                            break
                    else:
                        l = last[d - k]
                        ok = known(l << 20 | t)
                        if ok or (ok is None and fits(l, t)):
                            break
                last[d] = t
                coded[d] = coded[d - k] + units[t]
            key = now + w[n - 1]
            for k, t in (nodes(key) or make(key))[2]:
                if stands(t) if k == n else fits(last[n - k], t):
                    break
            out[w] = coded[n - k] + units[t]
            before, deep = w, n - 1
        return out

    def _long(self, w: str) -> list[int]:
        """The tokens of one long word: the same walk, which holds the last token of each prefix but not its encoding."""
        n, now = len(w), ""
        last = [-1] * n
        for d in range(1, n):
            key = now + w[d - 1]
            now, inside, _ = self.nodes.get(key) or self._node(key)
            last[d] = next(t for k, t in inside if (self.stands(t) if k == d else self.fits(last[d - k], t)))
        key = now + w[n - 1]
        k, t = next((k, t) for k, t in (self.nodes.get(key) or self._node(key))[2] if (self.stands(t) if k == n else self.fits(last[n - k], t)))
        out, at = [t], n - k
        while at:
            out.append(t := last[at])
            at -= self.size[t]
        return out[::-1]

    def in_bytes(self, word: str) -> str:
        if word.isascii():
            return word
        return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.alphabet)

    def library(self) -> Any:
        """The tokenizers library, for Unicode normalisation of texts beyond Latin."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.content)
        return self._library

    def pieces(self, text: str) -> list[Any]:
        """The text as keys: strings between white space, tuples of one word in bytes, bytes of special tokens."""
        out: list[Any] = []
        for part in _SPECIAL.split(text) if "<|" in text else (text,):
            if part in self.special:
                out.append(part.encode())
            elif not _PLAIN.search(part):
                out += part.lower().split()
            elif part:
                t = self.library()
                out += [(w,) for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(part)) if w]
        return out


class Encoder:
    """Encodes batches of texts; keeps the encodings of distinct pieces and words for later batches of the task.

    Encodings are sums of ``units``, one for each token. They are kept in two generations: when the
    younger has its bytes it becomes the older one, from which what occurs again is taken over. So
    what is held does not grow with the input, and all of it goes with the encoder.
    """

    def __init__(self, model: TrieBpe, units: list[Any], empty: Any, keep_bytes: int = KEEP_BYTES) -> None:
        self.model, self.units, self.empty, self.keep_bytes = model, units, empty, keep_bytes
        self.held = 0
        self.kept: dict[Any, Any] = {}
        self.old: dict[Any, Any] = {}

    def encode(self, batch: list[str]) -> list[Any]:
        """The encoding of each text.

        Kept are pieces; words too, where a piece has several or is not ASCII (then under a NUL and
        the word's bytes, as NUL is in no piece).
        """
        model, units, join = self.model, self.units, self.empty.join
        keyed = [model.pieces(t) for t in batch]
        if self.held > self.keep_bytes:
            self.old, self.kept, self.held = self.kept, {}, 0
        kept, old = self.kept, self.old
        new = set().union(*keyed).difference(kept)
        before = len(kept)
        if old:
            again = new.intersection(old)
            kept |= {p: old[p] for p in again}
            new -= again
        parts, ascii_words, byte_words = {}, set(), set()
        for p in new:
            if type(p) is str:
                if p.isascii():
                    if p.isalpha():
                        ascii_words.add(p)
                        continue
                    ws = _WORDS.findall(p)
                    ascii_words.update(ws)
                else:
                    ws = []
                    for w in (p,) if p.isalpha() else _WORDS.findall(p):
                        if w.isascii():
                            ascii_words.add(w)
                            ws.append(w)
                        else:
                            byte_words.add(w := model.in_bytes(w))
                            ws.append("\0" + w)
                parts[p] = ws
            elif type(p) is tuple:
                parts[p] = ["\0" + w for w in p]
                byte_words.update(p)
            else:
                kept[p] = units[model.special[p.decode()]]
        kept |= model.encode_words([w for w in ascii_words if w not in kept], units, self.empty)
        coded = model.encode_words([w for w in byte_words if "\0" + w not in kept], units, self.empty)
        kept |= {"\0" + w: c for w, c in coded.items()}
        for p, ws in parts.items():
            kept[p] = kept[ws[0]] if len(ws) == 1 else join([kept[w] for w in ws])
        # a key, an encoding and their place in the table; long pieces count by their length
        self.held += 220 * (len(kept) - before) + 4 * sum(len(p) for p in new if len(p) > 32)
        get = kept.__getitem__
        return [join(list(map(get, k))) for k in keyed]


@contextmanager
def task_encoder(content: str, units: Callable[[TrieBpe], list[Any]], empty: Any) -> Iterator[Encoder]:
    """An encoder for one task. Spark uses Python workers again for other stages, so nothing of it stays behind."""
    model = TrieBpe(content)
    try:
        yield Encoder(model, units(model), empty)
    finally:
        pa.default_memory_pool().release_unused()


def broadcast_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file's text, a few MB whatever the input; executors need no copy of the file."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _decimal(model: TrieBpe) -> list[str]:
    """Units that make up decimal ids, each followed by a space."""
    return [f"{i} " for i in range(len(model.tokens))]


def decode(tokens: dict[str, str], ids: str) -> str:
    """The text of decimal ids: their tokens, joined by one space."""
    return " ".join(map(tokens.__getitem__, ids.split()))


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by one space) and decoded text of each row of ``docs``.

    Null and empty texts have no tokens and decode to an empty text. Repeated rows are encoded
    each; other columns are ignored. Rows keep their partitions: nothing is shuffled.
    """
    vocabulary = broadcast_vocabulary(docs.sparkSession, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_encoder(vocabulary.value, _decimal, "") as encoder:
            tokens = {str(i): t for i, t in enumerate(encoder.model.tokens)}
            for batch in slices(batches, ROWS, SIZE):
                ids = [x[:-1] for x in encoder.encode(texts(batch))]
                n = [x.count(" ") + 1 if x else 0 for x in ids]
                words = [decode(tokens, x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(words, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"]
                )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")
