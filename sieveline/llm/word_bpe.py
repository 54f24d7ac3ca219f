"""Ids of a `tokenizers` file whose pre-tokenizer drops white space and whose words end with a mark, chunk by chunk.

A call per chunk costs more than its merges, so plain chunks (Latin letters, then perhaps punctuation) are joined by
spaces and encoded together; word-end marks tell where each chunk's ids end. If the marks don't add up, and for all
other chunks, each chunk is encoded alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

from .spans import Chunks, picked

#: One pre-token of letters, then one of punctuation or none.
PLAIN = re.compile(r"[ \n]?[A-Za-zÀ-ÖØ-öø-ÿ]+([.,;:!?#$%&*()\[\]|<>]*)")
GROUP = 256
#: Texts that the library encodes in one call.
GROUPS = 32
WORD_END = "</w>"

_open: dict[tuple[str, bool], Chunks] = {}


def reader(path: str, plain: bool = False) -> Chunks:
    """The worker's chunks for the tokenizer file at path, which every executor has.

    The strings of special tokens in a text are these tokens, as the library has it; plain: they are ordinary text.
    """
    if (path, plain) not in _open:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = plain
        vocab = t.get_vocab(with_added_tokens=True)
        ends = np.zeros(max(vocab.values()) + 1, bool)
        ends[[i for token, i in vocab.items() if token.endswith(WORD_END)]] = True

        def alone(texts: list[str]) -> Iterator[np.ndarray]:
            # an encoding takes far more room than its ids, so few are held at once
            for i in range(0, len(texts), GROUPS):
                yield from [np.array(e.ids, np.uint32) for e in t.encode_batch_fast(texts[i : i + GROUPS], add_special_tokens=False)]

        def encode(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            texts = [c.decode("utf-8", "replace") for c in chunks]
            found = [(i, m.end() > m.start(1)) for i, m in enumerate(map(PLAIN.fullmatch, texts)) if m]
            joined, words = np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64) + 1
            groups = [[texts[i] for i in joined[g : g + GROUP].tolist()] for g in range(0, len(joined), GROUP)]
            flat, lens, rows, rest = [], [], [], np.ones(len(texts), bool)
            for k, ids in enumerate(alone([" ".join(g) for g in groups])):
                own = slice(k * GROUP, k * GROUP + len(groups[k]))
                last = np.cumsum(words[own])
                at = np.flatnonzero(ends[ids]) + 1
                if len(at) == last[-1] and at[-1] == len(ids):
                    flat.append(ids)
                    lens.append(np.diff(at[last - 1], prepend=0))
                    rows.append(joined[own])
                    rest[joined[own]] = False
            left = np.flatnonzero(rest)
            one = list(alone([texts[i] for i in left.tolist()]))
            flat += one
            lens.append(np.fromiter(map(len, one), np.int64, len(one)))
            every, size = np.concatenate([np.zeros(0, np.uint32), *flat]), np.concatenate(lens)
            order = np.argsort(np.concatenate([*rows, left]))
            return picked(every, size, order), size[order]

        _open[path, plain] = Chunks(encode)
    return _open[path, plain]
