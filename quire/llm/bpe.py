"""Byte-level BPE by prefix-sharing trie traversal.

The text is cut into words by the tokenizer's pattern. The pattern is stated here for speed; of each code point met,
a worker asks the tokenizer's library once whether it takes it for a letter, a number, white space or neither, and
texts with a code point that the pattern engine at hand takes for something else (newer letters, as a rule) are
cut by the library itself. So the ids depend on no other Unicode tables than the library's. The distinct words of a slice that are not known yet
go into a trie, which is walked depth first: at each node the walk settles the last token of the encoding of
the prefix that ends there. There is exactly one: a vocabulary token that ends the prefix, that the merges
do build from its own bytes, and that stays apart from the last token of the prefix before it. So a prefix
that many words share is encoded once, and a word's ids are read off by stepping back token by token. The
trie is held as the sorted words: neighbours share their path down to their common prefix, and the walk
keeps only the states of the current path. Finished words stay in a bounded dictionary per worker.

Decoding maps ids to bytes and reads the bytes as UTF-8, with U+FFFD for what is not.

Defined cases: null and empty texts have no ids and decode to ''. A special token's string in a text becomes
its id, as the library does by default. Rows are kept one for one, in any number of copies; texts of any
length are cut into words piecewise, never shortened; clashing columns are replaced.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .arrow import texts, with_columns

#: Fixed value: the pattern of byte-level tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a worker keeps; then the dictionary starts anew.
KEPT_WORDS = 300_000
#: Words that may stay for a worker's next task.
IDLE_WORDS = 100_000
#: Pairs of tokens whose meeting a worker remembers.
KEPT_PAIRS = 500_000
#: Words of one text that are held at once.
WORDS_AT_ONCE = 200_000
LEAF, NEVER = -1, 1 << 40


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, the rest for U+0100 and on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Tokens as bytes, with the merge that makes each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters, model = byte_letters(), told["model"]
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        spelled = lambda s: bytes(letters[c] for c in s)
        self.ids = {spelled(s): i for s, i in model["vocab"].items() if s not in self.special}
        self.spelling = [b""] * (max([*model["vocab"].values(), *self.special.values()]) + 1)
        for s, i in self.ids.items():
            self.spelling[i] = s
        for s, i in self.special.items():
            self.spelling[i] = s.encode()
        self.born = [LEAF] * len(self.spelling)
        self.halves: list[tuple[int, int] | None] = [None] * len(self.spelling)
        self.merges: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (spelled(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = self.ids[a + b]
            self.merges[self.ids[a], self.ids[b]] = rank
            if self.halves[whole] is None:
                self.halves[whole], self.born[whole] = (self.ids[a], self.ids[b]), rank
        self.endings = {s[k:] for s in self.ids for k in range(len(s))}
        self._apart: dict[tuple[int, int], bool] = {}
        self._real: dict[int, bool] = {}

    def _meets(self, a: int, b: int, until: int) -> bool:
        """Whether the merges join anything across the border of a and b before rank `until`.

        Goes back in time: a and b are the tokens at the border, each until it grew into the one seen before.
        """
        a_grew = b_grew = until
        while True:
            rank = self.merges.get((a, b))
            # Of equal ranks the left one goes first: the growth of a before the border, the border before the growth of b.
            if rank is not None and rank < a_grew and rank <= b_grew and rank < until:
                return True
            if self.born[a] > self.born[b]:
                a_grew, a = self.born[a], self.halves[a][1]
            elif self.born[b] != LEAF:
                b_grew, b = self.born[b], self.halves[b][0]
            else:
                return False

    def apart(self, a: int, b: int) -> bool:
        """Whether a and b stay two tokens when they meet."""
        known = self._apart.get((a, b))
        if known is None:
            if len(self._apart) >= KEPT_PAIRS:
                self._apart.clear()
            known = self._apart[a, b] = not self._meets(a, b, NEVER)
        return known

    def real(self, t: int) -> bool:
        """Whether the merges make t of its bytes."""
        known = self._real.get(t)
        if known is None:
            halves = self.halves[t]
            known = halves is None or self.real(halves[0]) and self.real(halves[1]) and not self._meets(*halves, self.born[t])
            self._real[t] = known
        return known

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """Each word with its ids, in sorted order: a depth-first walk of the words' trie."""
        ids, endings, apart, real = self.ids, self.endings, self.apart, self.real
        last, size = [-1], [0]  # of each prefix on the path: the last token and its bytes
        path = b""
        for word in sorted(words):
            shared = 0
            for x, y in zip(path, word):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], size[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for start in range(end - 1, -1, -1):
                    ending = word[start:end]
                    t = ids.get(ending)
                    if t is not None and real(t) and (not start or apart(last[start], t)):
                        last.append(t)
                        size.append(end - start)
                        break
                    if ending not in endings:
                        raise ValueError(f"no token ends {word[:end]!r}")
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
            path, found, end = word, [], len(word)
            while end:
                found.append(last[end])
                end -= size[end]
            found.reverse()
            yield word, found


class Encoder:
    """Texts to ids, with the dictionary of finished words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.vocabulary = Vocabulary(path)
        self.pattern = regex.compile(PATTERN)
        self.cutter = Tokenizer.from_file(path).pre_tokenizer
        self.classes = [regex.compile(x) for x in (r"\p{L}", r"\p{N}", r"\s")]
        #: Code points that the library and the pattern class alike, and those that they do not.
        self.alike, self.strange = set(map(chr, range(128))), set()
        special = self.vocabulary.special
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.known: dict[str, bytes] = {}

    def _probe(self, c: str) -> bool:
        """Whether the library has c in the same class as the pattern: with which neighbour does it make a word?"""
        joins = [len(self.cutter.pre_tokenize_str(x + c)) == 1 for x in ("a", "1", "!")]
        own = [bool(p.match(c)) for p in self.classes]
        return joins == [own[0], own[1], not any(own)]

    def _meet(self, text: str) -> None:
        for c in set(text) - self.alike - self.strange:
            (self.alike if self._probe(c) else self.strange).add(c)

    def _cut_by_library(self, text: str) -> Iterator[list[str]]:
        """The library's words, a slice at a time: a word that ends before a slice's last character is whole."""
        at, size = 0, WORDS_AT_ONCE
        while at < len(text):
            part = text[at : at + size]
            ends = [b for _, (_, b) in self.cutter.pre_tokenize_str(part)]
            if at + size < len(text):
                ends = [b for b in ends if b < len(part) - 1]
                if not ends:
                    size *= 2
                    continue
            yield [part[a:b] for a, b in zip([0, *ends], ends)]
            at, size = at + ends[-1], WORDS_AT_ONCE

    def _words(self, text: str) -> Iterator[list[str]]:
        """The words of a text whose code points have been met."""
        parts = self.cut.split(text) if self.cut else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield [part]
            elif self.strange and not self.strange.isdisjoint(part):
                yield from self._cut_by_library(part)
            elif len(part) <= WORDS_AT_ONCE:
                yield self.pattern.findall(part)
            else:
                found = (m[0] for m in self.pattern.finditer(part))
                while run := list(islice(found, WORDS_AT_ONCE)):
                    yield run

    def _learn(self, words: Iterable[str]) -> None:
        special = self.vocabulary.special
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        new = {w for w in words if w not in self.known}
        for s in new & special.keys():
            self.known[s] = np.uint32(special[s]).tobytes()
        for word, ids in self.vocabulary.encode_words(w.encode() for w in new - special.keys()):
            self.known[word.decode()] = np.array(ids, "<u4").tobytes()

    def rest(self) -> None:
        """Between tasks a worker keeps little, as other work needs its memory: the words that came first, so the frequent ones."""
        if len(self.known) > IDLE_WORDS:
            self.known = dict(islice(self.known.items(), IDLE_WORDS))

    def encode_batch(self, batch: list[str]) -> list[bytes]:
        """Of each text the ids, as little-endian unsigned 32-bit integers."""
        whole, runs = [], []
        for text in batch:
            if not text.isascii():
                self._meet(text)
            if len(text) <= WORDS_AT_ONCE:
                runs.append([w for run in self._words(text) for w in run])
        self._learn({w for run in runs for w in run})
        held = iter(runs)
        for text in batch:
            if len(text) <= WORDS_AT_ONCE:
                whole.append(b"".join(map(self.known.__getitem__, next(held))))
        if len(whole) == len(batch):
            return whole
        short, out = iter(whole), []
        for text in batch:
            if len(text) <= WORDS_AT_ONCE:
                out.append(next(short))
                continue
            pieces = []
            for run in self._words(text):
                self._learn(set(run))
                pieces.append(b"".join(map(self.known.__getitem__, run)))
            out.append(b"".join(pieces))
        return out

    def decode(self, ids: bytes) -> str:
        decoder, out = codecs.getincrementaldecoder("utf-8")("replace"), []
        spelling = self.vocabulary.spelling
        for k in range(0, len(ids), 4 * WORDS_AT_ONCE):
            some = np.frombuffer(ids[k : k + 4 * WORDS_AT_ONCE], "<u4").tolist()
            out.append(decoder.decode(b"".join(map(spelling.__getitem__, some))))
        return "".join([*out, decoder.decode(b"", True)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One a worker process."""
    return Encoder(path)


def encode(docs: DataFrame, text: str = "text", path: str | None = None, keep_text: bool = True) -> DataFrame:
    """docs with ids (binary: little-endian unsigned 32-bit integers) and n_tokens."""
    path = path or default_path()

    def make():
        own = encoder(path)

        def work(part: pa.RecordBatch):
            ids = own.encode_batch(texts(part, text))
            return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]

        return work

    return with_columns(docs, "ids binary, n_tokens bigint", make, by=text, drop=() if keep_text else (text,), done=lambda: encoder(path).rest())


def decode(docs: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """docs with decoded, the text of ids."""
    path = path or default_path()

    def make():
        own = encoder(path)
        return lambda part: [pa.array([own.decode(x or b"") for x in part.column(ids).to_pylist()], pa.string())]

    return with_columns(docs, "decoded string", make, by=ids)
