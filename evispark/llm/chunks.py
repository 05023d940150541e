"""Token ids of whole texts by a public tokenizer, with a memo per white-space chunk.

The tokenizer used here (word_bpe_49k.json) splits at white space before anything else, so the ids
of a text are the ids of its ASCII-white-space chunks in order. Pseudo-random or natural, words
repeat; each worker therefore asks the tokenizers library once per distinct chunk and joins the
remembered ids. ``tests/llm`` holds this against the library's encoding of whole texts.
"""

from __future__ import annotations

import os
from itertools import chain, repeat

import numpy as np

from .common import held

#: Distinct chunks remembered by a worker; beyond that the memo starts anew.
MEMO = 1_100_000

#: Chunks encoded in one call: the library's results are far larger than the ids.
BLOCK = 8192

#: Stands for ids not known yet; ids have four bytes each.
_UNKNOWN = b"?"

_TRAIL = b",.!?;:%$*#&"
_PLAIN = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
#: Second bytes of the letters that begin with C3: sharp s to y with dots, but for the sign of division.
_LATIN = frozenset(range(0x9F, 0xC0)) - {0xB7}


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.memo: dict[bytes, bytes] = {}
        self.limit = memo
        self.word_end = np.zeros(self.library.get_vocab_size() + 1, bool)
        self.word_end[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        ends = [i for t, i in self.library.get_vocab().items() if (x := t.removesuffix("</w>")) != t and x and x[0] in ".!?"]
        self.sentence_end = np.zeros(self.library.get_vocab_size() + 1, bool)
        self.sentence_end[ends] = True

    @classmethod
    def at(cls, path: str) -> "ChunkEncoder":
        return held(path, lambda: cls(path))

    def _words(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces that are one run of letters each: the tokenizer's pattern keeps such a
        run whole, and only its last token ends a word, so one call takes them all. A piece that its
        normaliser splits shows in the count of ends."""
        ids = np.array(self.library.encode_batch_fast([b" ".join(pieces).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = np.nonzero(self.word_end[ids])[0] + 1
        if len(ends) != len(pieces):
            return self._library(pieces)
        flat, cuts = ids.tobytes(), (4 * ends).tolist()
        return [flat[a:b] for a, b in zip([0, *cuts], cuts)]

    def _library(self, pieces: list[bytes]) -> list[bytes]:
        got = self.library.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        ids = [x.ids for x in got]
        flat = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        out, at = [], 0
        for x in ids:
            out.append(flat[at : (at := at + 4 * len(x))])
        return out

    def learn(self, chunks: set[bytes]) -> None:
        """Remember the ids of chunks not seen before.

        A chunk that ends in a letter of Latin-1 or a digit plus sentence punctuation is the ids of its
        stem plus those of the punctuation and signs, since the tokenizer's pattern splits there.
        """
        memo, new, stems = self.memo, [], {}
        for c in chunks.difference(memo):
            stem = c.rstrip(_TRAIL)
            if stem and stem is not c and len(stem) != len(c) and (stem[-1] in _PLAIN or stem[-1] in _LATIN and stem[-2:-1] == b"\xc3"):
                stems[c] = (stem, c[len(stem) :])
            else:
                new.append(c)
        if stems:
            more = {x for pair in stems.values() for x in pair} - memo.keys() - set(new)
            new.extend(more)
        plain = [c for c in new if c.decode().isalpha()]
        other = set(new).difference(plain)
        for some, encode in ((plain, self._words), (list(other), self._library)):
            for a in range(0, len(some), BLOCK):
                memo.update(zip(some[a : a + BLOCK], encode(some[a : a + BLOCK])))
        for c, (stem, tail) in stems.items():
            memo[c] = memo[stem] + memo[tail]

    def batch(self, texts: list[str | None]) -> list[list[bytes]]:
        """For each text, the ids of its chunks."""
        if len(self.memo) > self.limit:
            self.memo.clear()
        split = []
        for t in texts:
            b = (t or "").encode()
            # The library lower-cases too; its special tokens are matched before that.
            split.append((b if b"<|" in b else b.lower()).split())
        found = [list(map(self.memo.get, s, repeat(_UNKNOWN))) for s in split]
        gaps = []
        for words, ids in zip(split, found):
            for _ in range(ids.count(_UNKNOWN)):
                at = ids.index(_UNKNOWN, gaps[-1][1] + 1 if gaps and gaps[-1][0] is ids else 0)
                gaps.append((ids, at, words[at]))
        self.learn({word for _, _, word in gaps})
        for ids, at, word in gaps:
            ids[at] = self.memo[word]
        return found
