"""Texts as terms: runs without ASCII white space whose token ids do not depend on what stands around them.

Exact for tokenizers that drop white space and never merge across it. Two steps lessen the number of distinct terms: A-Z are
lower-cased when the tokenizer lower-cases anyway (not in texts with combining marks, where lower-casing before composition could
differ), and a comma or full stop between an ASCII letter and white space is cut off. Texts with ``<|`` take neither
step: special tokens are matched before lower-casing.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

TAIL = re.compile(rb"(?<=[a-z])([.,])(?=[\x09-\x0d ]|\Z)")
BATCH = 400
SEPARATOR = "\x01"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def terms(text: bytes) -> list[bytes]:
    if b"\xcc" not in text and b"\xcd" not in text and b"<|" not in text:
        text = TAIL.sub(rb" \1", text.lower())
    return text.split()


def encode_bytes(path: str, batch: list[bytes]) -> list[bytes]:
    """Ids of each term as the library gives them, as little-endian 32-bit numbers: many terms to a call with a separator whose id no other text yields."""
    tok = tokenizer(path)
    mark = tok.encode(SEPARATOR, add_special_tokens=False).ids
    words = [t.decode("utf-8", "replace") for t in batch]
    plain = [i for i, w in enumerate(words) if len(mark) == 1 and SEPARATOR not in w and "<|" not in w]
    out: list[bytes | None] = [None] * len(words)
    for lo in range(0, len(plain), BATCH):
        part = plain[lo:lo + BATCH]
        ids = np.array(tok.encode(f" {SEPARATOR} ".join([words[i] for i in part]), add_special_tokens=False).ids, "<u4")
        cuts = 4 * np.flatnonzero(ids == mark[0])
        if len(cuts) == len(part) - 1:
            raw = ids.tobytes()
            for i, start, end in zip(part, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)], strict=True):
                out[i] = raw[start:end]
    odd = [i for i, x in enumerate(out) if x is None]
    for i, e in zip(odd, tok.encode_batch([words[i] for i in odd], add_special_tokens=False), strict=True):
        out[i] = np.array(e.ids, "<u4").tobytes()
    return out
