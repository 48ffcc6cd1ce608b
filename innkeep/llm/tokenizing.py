"""Token ids of the public byte-level BPE vocabulary, inside tasks.

The ids are those of ``tokenizers`` on ``byte_bpe_50k.json`` with
``add_special_tokens=False``: the string of an added token in a text is that
token.  ``tiktoken`` holds the same vocabulary and is five times as fast; the
two agree on every text of code points below U+0250 and on general punctuation
(``tests/llm/test_packing.py``).  Above that their Unicode tables may differ,
and added tokens are not in its vocabulary, so such texts go through
``tokenizers`` itself.

A run of hundreds of thousands of white space characters overflows
``tiktoken``'s pattern matcher.  The pattern takes such a run as one piece, but
for its last character where a word follows, so it is cut out and encoded as
that piece."""

from __future__ import annotations

import base64
import functools
import json
import re

import numpy as np

DEFAULT_JSON = "byte_bpe_50k.json"
#: texts within these code points are encoded alike by both libraries (fixed values)
COMMON = re.compile("[^\u0000-ɏ‐-‧‰-⁞€]")
#: white space of the vocabulary's pattern (fixed values), in runs that are cut out
LONG_RUN = 100_000
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)


@functools.cache
def _slow(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path(name))


@functools.cache
def _added(name: str) -> tuple[str, ...]:
    """Strings that are tokens of their own: the file's list of them, without
    reading the vocabulary into objects."""
    import public_tokenizers
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        text = f.read()
    at = re.search(r'"added_tokens"\s*:\s*', text).end()
    return tuple(t["content"] for t in json.JSONDecoder().raw_decode(text, at)[0])


@functools.cache
def _fast(name: str):
    import public_tokenizers
    import tiktoken
    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _fast_ids(text: str, name: str) -> list[int]:
    enc = _fast(name)
    if len(text) < LONG_RUN:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for run in SPACES.finditer(text):
        piece = run.end() if run.end() == len(text) else run.end() - 1
        ids += enc.encode_ordinary(text[at:run.start()])
        ids += enc._encode_single_piece(text[run.start():piece])
        at = piece
    return ids + enc.encode_ordinary(text[at:])


def token_ids(text: str, name: str = DEFAULT_JSON) -> list[int]:
    """Ids of a whole text.  ``name``: a file of the public tokenizers; a
    ``.json`` byte-level BPE is read through its ``.tiktoken`` twin where the
    two agree, a ``.tiktoken`` file is used directly."""
    if name.endswith(".tiktoken"):
        return _fast_ids(text, name)
    if COMMON.search(text) is None and not any(t in text for t in _added(name)):
        return _fast_ids(text, name.removesuffix(".json") + ".tiktoken")
    return _slow(name).encode(text, add_special_tokens=False).ids


def token_array(text: str, last: int | None, name: str = DEFAULT_JSON) -> np.ndarray:
    """``token_ids`` as little-endian unsigned 32-bit numbers, with ``last`` after them."""
    ids = token_ids(text, name)
    if last is not None:
        ids.append(last)
    return np.array(ids, dtype="<u4")
