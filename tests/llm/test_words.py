"""op8's short way for words: the same ids as the tokenizer's whole way, which plain words don't take."""

import numpy as np
import public_tokenizers
from corvane.llm import packing


def test_plain_words_go_to_the_model():
    words = packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    whole, taken = words.encode, []
    words.encode = lambda run: taken.append(run) or whole(run)
    plain = ["ungchein", "leséanréou", "ÉCIÓN", "Straße", "über,"]
    odd = ["don't", "×a", "Σς", "été", "a1b", "<|endoftext|>", "x<|endoftext|>", "İ", "a,b", "ÿx'", "é&&&'s", "K"]
    for text in plain + odd:
        assert words.ids(text.encode()) == np.array(words.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
    assert words.short and not [r for r in taken if r.decode() in plain] and b"don't" in taken
