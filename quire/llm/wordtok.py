"""Token ids of whole texts by a public tokenizer whose words are encoded one by one.

The tokenizer's own library encodes each distinct word once per worker; texts are looked up word by word.
That holds for texts of plain letters (below U+0250), for which the tokenizer's normalisation and word pattern
are stated here; any other text, and one that may hold a special token, goes to the library whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np

KEPT_WORDS = 500_000
#: Words that may stay for a worker's next task.
IDLE_WORDS = 100_000
#: Words that the library encodes in one call, as one text.
WORDS_A_CALL = 200
WORDS_AT_ONCE = 200_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _plain() -> tuple[str, str, str]:
    """Letters, digits and all characters (as bodies of classes) of the texts that are looked up here."""
    blanks = "\t\n\x0b\x0c\r \xa0"
    whole = [c for c in map(chr, range(0x20, 0x250)) if unicodedata.category(c)[0] != "C" and c not in "\x85İ" and len(c.lower()) == 1 and ord(c.lower()) < 0x250]
    letters = [c for c in whole if unicodedata.category(c)[0] == "L" and c == c.lower()]
    digits = [c for c in whole if unicodedata.category(c)[0] == "N"]
    body = lambda cs: "".join(map(re.escape, cs))
    return body(letters), body(digits), body([*whole, *blanks])


LETTERS, DIGITS, WHOLE = _plain()
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\t\n\x0b\x0c\r \xa0{LETTERS}{DIGITS}]+")
STRANGE = re.compile(rf"[^{WHOLE}]|<\|")


class WordTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.known: dict[str, bytes] = {}
        names = self.library.get_vocab()
        self.ends_word = np.zeros(max(names.values()) + 1, bool)
        self.ends_word[[i for name, i in names.items() if name.endswith("</w>")]] = True

    def _ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        for k in range(0, len(new), WORDS_A_CALL):
            some = new[k : k + WORDS_A_CALL]
            ids = np.array(self.library.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            stops = 4 * (np.flatnonzero(self.ends_word[ids]) + 1)
            if len(stops) == len(some):
                data, start = ids.tobytes(), 0
                for w, stop in zip(some, stops.tolist(), strict=True):
                    self.known[w], start = data[start:stop], stop
            else:  # not met so far: a word of another shape than the pattern's
                self.known.update((w, self._ids(w)) for w in some)

    def _runs(self, text: str) -> Iterator[list[str]]:
        found = (m[0] for m in WORD.finditer(text.lower()))
        while run := list(islice(found, WORDS_AT_ONCE)):
            yield run

    def rest(self) -> None:
        """Between tasks a worker keeps little, as other work needs its memory: the words that came first, so the frequent ones."""
        if len(self.known) > IDLE_WORDS:
            self.known = dict(islice(self.known.items(), IDLE_WORDS))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Of each text the ids, as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(texts)
        words: dict[int, list[str]] = {}
        for k, text in enumerate(texts):
            if STRANGE.search(text):
                out[k] = self._ids(text)
            elif len(text) <= WORDS_AT_ONCE:
                words[k] = WORD.findall(text.lower())
            else:
                pieces = []
                for run in self._runs(text):
                    self._learn(set(run))
                    pieces.append(b"".join(map(self.known.__getitem__, run)))
                out[k] = b"".join(pieces)
        self._learn({w for run in words.values() for w in run})
        for k, run in words.items():
            out[k] = b"".join(map(self.known.__getitem__, run))
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One a worker process."""
    return WordTokenizer(path)
