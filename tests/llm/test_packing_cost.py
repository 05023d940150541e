"""Words before signs are known by their stems, and the exact look-ups of the cuts are those of a plain search."""

import numpy as np
import public_tokenizers

from evispark.llm import packing
from evispark.llm.chunks import ChunkEncoder

TAILS = ["%%%", "$$$", "***", "###", "&&&", ",%%%", ".###", "?!", "$", "#.", "*&%$#"]


def test_signs_after_a_word_need_no_call_of_their_own(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, whole = ChunkEncoder(path), []
    library = ChunkEncoder._library
    monkeypatch.setattr(ChunkEncoder, "_library", lambda self, pieces: (whole.extend(pieces), library(self, pieces))[1])
    words = [w + t for w in ("reheea", "thingtion", "x9", "9", "erein\u00f6", "stra\u00df") for t in TAILS]
    for word, ids in zip(words, encoder.batch(words)):
        assert b"".join(ids) == b"".join(i.to_bytes(4, "little") for i in encoder.library.encode(word, add_special_tokens=False).ids), word
    assert not {w.encode() for w in words} & set(whole)


def plain_cost(pos, penalty, size):
    best = [0]
    for j in range(1, len(pos)):
        length = [int(pos[j] - pos[i]) for i in range(j)]
        pad = [0 if n & (n - 1) == 0 else size - n for n in length]
        best.append(min(best[i] + pad[i] for i in range(j) if length[i] <= size) + packing.SEQUENCE_COST + int(penalty[j]))
    return best[-1]


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(7)
    for size in (1, 8, 64):
        for _ in range(20):
            pos = np.concatenate(([0], np.cumsum(rng.integers(1, min(size, 12) + 1, 60))))
            penalty = rng.integers(0, 25, len(pos))
            cuts = [0, *packing.best_cuts(pos, penalty, size)]
            length = np.diff(pos[cuts])
            pad = np.where(length & (length - 1) == 0, 0, size - length)
            assert length.max() <= size and cuts[-1] == 60
            assert pad.sum() + packing.SEQUENCE_COST * len(length) + penalty[cuts[1:]].sum() == plain_cost(pos, penalty, size)
