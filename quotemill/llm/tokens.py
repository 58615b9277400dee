"""Token ids of whole texts, by the public byte-level BPE."""

from __future__ import annotations

import base64
import re
import sys
from array import array
from functools import lru_cache

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Texts the quick way may take: no two blanks together, and letters whose class no library disputes.
_BLANKS = re.compile(r"\s\s").search
_FOREIGN = re.compile("[^\t\n\r -~\xa1-ɏ–-„]").search


class Encoder:
    """``Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids``, little-endian.

    The vocabulary's word pattern looks ahead only for runs of blanks. Texts without such runs are cut
    by the pattern less that part, which is much faster and gives the same ids; texts with runs, with
    a special token or with rarer characters go to the tokenizer itself.
    """

    def __init__(self, vocabulary: str = VOCABULARY, ranks: str = RANKS):
        self.whole = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        pattern = public_tokenizers.PATTERN.replace(r"\s+(?!\S)|", "")
        self.quick = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def encode(self, text: str) -> array:
        if _BLANKS(text) or _FOREIGN(text) or any(s in text for s in self.special):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.quick.encode_ordinary(text)
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY, ranks: str = RANKS) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(vocabulary, ranks)
