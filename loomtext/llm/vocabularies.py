"""Places of the public vocabulary files; callers of the operators pass them as parameters."""

from __future__ import annotations

import public_tokenizers

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_PATTERN = public_tokenizers.PATTERN
