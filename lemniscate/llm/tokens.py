"""Byte-level BPE ids of whole texts, cached by space-separated chunk inside each task.

The vocabulary's pretokens never reach across a change from a character that
isn't white space to a space.  So a text cut before single spaces can be
encoded chunk by chunk, and equal chunks get equal ids: each task looks chunks
up and encodes only new ones.  Texts with other white space next to a cut, or
with a special token's string, are encoded whole.
"""

from __future__ import annotations

import base64
from functools import lru_cache

#: Id that ends every document.
END = 0
#: Chunks that a task's cache holds before it is emptied; a matter of memory only.
CACHE = 250_000


@lru_cache(maxsize=2)
def encoder(path: str, ranks_path: str):
    """A function text -> bytes: the ids as little-endian unsigned 32-bit numbers.

    ``path`` is the tokenizer; ``ranks_path`` the same vocabulary as ranks,
    with which ordinary text is encoded several times as fast.
    """
    import numpy as np
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    cache: dict[str, bytes | None] = {}

    def ids(text: str) -> bytes:
        return np.array(fast.encode_ordinary(text), dtype="<u4").tobytes()

    def chunk(word: str) -> bytes | None:
        """Ids of a space and ``word``; None if the word cannot stand alone."""
        if len(cache) >= CACHE:
            cache.clear()
        out = ids(" " + word) if word and not word[0].isspace() and not word[-1].isspace() else None
        if len(word) <= 64:
            cache[word] = out
        return out

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            return np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        try:
            text.encode("utf-8")
        except UnicodeEncodeError:
            text = text.encode("utf-8", "replace").decode("utf-8")
        words = text.split(" ")
        first = words[0]
        if not first or first[-1].isspace():
            return ids(text)
        out = [ids(first)]
        known = cache.get
        for w in words[1:]:
            got = known(w) or chunk(w)
            if got is None:
                return ids(text)
            out.append(got)
        return b"".join(out)

    return encode
