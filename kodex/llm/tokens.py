"""Token counts and offsets of public tokenizers, whose files stay where they are."""

from __future__ import annotations

import base64
import importlib.util
from functools import cache

import numpy as np

#: Folder of the tokenizers' files.
FOLDER = "/opt/tokenizers"
#: The tokenizer with one token for each UTF-8 byte.
BYTES = "bytes"


@cache
def encoding(name: str, folder: str = FOLDER):
    """A tiktoken encoding of a rank file of `folder`, with its pattern; one per worker process."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("_tokenizer_folder", f"{folder}/__init__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(f"{folder}/{name}", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(texts: list[str], name: str, folder: str = FOLDER) -> list[int]:
    if name == BYTES:
        return [len(t.encode("utf-8", "surrogatepass")) for t in texts]
    e = encoding(name, folder)
    return [len(e.encode_ordinary(t)) for t in texts]


def prefix(text: str, name: str, folder: str = FOLDER) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that begin before each character position (0 to len), and the positions at which a token begins."""
    if name == BYTES:
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        width = 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF)
        return np.concatenate([[0], np.cumsum(width)]), np.arange(len(text) + 1)
    e = encoding(name, folder)
    starts = np.array(e.decode_with_offsets(e.encode_ordinary(text))[1], np.int64)
    # a character in several tokens: the later ones have the same offset
    return np.searchsorted(starts, np.arange(len(text) + 1)), np.append(np.unique(starts), len(text))
