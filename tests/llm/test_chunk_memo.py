"""Only chunks that a worker hasn't met are gathered and encoded."""

import public_tokenizers

from evispark.llm.chunks import ChunkEncoder


def test_known_chunks_are_not_gathered_again(monkeypatch):
    encoder, asked, learn = ChunkEncoder(public_tokenizers.path("word_bpe_49k.json")), [], ChunkEncoder.learn
    monkeypatch.setattr(ChunkEncoder, "learn", lambda self, chunks: (asked.append(set(chunks)), learn(self, chunks))[1])
    texts = ["one two, one two.", "", None, "two three! three", "one"]
    assert encoder.batch(texts) == ChunkEncoder(public_tokenizers.path("word_bpe_49k.json")).batch(texts)
    asked.clear()
    again = encoder.batch(["one new two,", "newer one new"])
    assert asked == [{b"new", b"newer"}]
    for text, ids in zip(["one new two,", "newer one new"], again):
        assert b"".join(ids) == b"".join(i.to_bytes(4, "little") for i in encoder.library.encode(text, add_special_tokens=False).ids)
