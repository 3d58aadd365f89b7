"""Special tokens in any case, and listed words after Unicode marks."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from whyframe.llm.queries import word_tokenizer
from whyframe.llm.terms import encode_bytes, terms
from whyframe.llm.toxicity import Lexicon, fold

@pytest.mark.parametrize("text", ["a<|ENDOFTEXT|>b", "A<|EndOfText|>b. End.", "<|endoftext|>, Tail.", "x <| Y. |> Z,"])
def test_special_tokens_are_matched_on_the_raw_text(text):
    want = Tokenizer.from_file(word_tokenizer()).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(b"".join(encode_bytes(word_tokenizer(), terms(text.encode()))), "<u4").tolist() == want

@pytest.mark.parametrize("text", ["¡idiot!", "„Idiot“", "“idiot”", "«idiot»", "you—idiot", "you idiot", "you　idiot。"])
def test_listed_words_after_unicode_marks(text):
    lex = Lexicon(((fold("idiot"), 3.0),))
    assert lex.strength(text) > 0
    assert fold("été").count(" ") == 0 and lex.strength("péidiot") == 0
