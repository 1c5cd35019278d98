"""How long an encoder keeps the words it has learnt."""

import numpy as np

from strideframe.llm import tokens


def test_an_encoder_keeps_as_many_words_as_it_is_told(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    texts = ["one two three four five", "six seven, one two", "eight\nnine ten"]
    import public_tokenizers

    kept, small = (tokens.WordEncoder(public_tokenizers.path("byte_bpe_50k.json")) for _ in range(2))
    kept.most_words = 100
    for text in texts:
        want = kept.lib.encode(text, add_special_tokens=False).ids
        assert np.array_equal(kept.encode([text])[0], want) and np.array_equal(small.encode([text])[0], want)
    assert "four" in kept.words and "four" not in small.words


class Counting(dict):
    looked_up = 0

    def get(self, *key):
        self.looked_up += 1
        return super().get(*key)


def test_a_word_is_looked_up_once_a_call():
    import public_tokenizers

    odd = ["", " ", "a  b   c", "\n\n a", "tab\there now", "ΑΣ ΣΑΣ", "x\0y \1z", "<|endoftext|> a b", "end \n", "🙂 🙂🙂 ok, 日本 語。"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc = tokens.WordEncoder(public_tokenizers.path(name))
        enc.words = Counting(enc.words)
        texts = ["one two, three\n" * 500, *odd, "three one two, " * 500]
        for text, got in zip(texts, enc.encode(texts), strict=True):
            assert got.tolist() == enc.lib.encode(text, add_special_tokens=False).ids
        assert enc.words.looked_up < 200
