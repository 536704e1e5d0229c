"""Whole texts to ids with a ``tokenizers`` file, each distinct white-space-free chunk encoded once per memo.

Valid for tokenizers that drop white space and never join over it (normaliser and pre-tokeniser act on each side alone):
then a text's ids are its chunks' ids in a row. Chunks are split at the six ASCII white-space bytes only; any other
white space stays inside a chunk and is left to the tokenizer. A text that holds an added token of the tokenizer, such as an
end mark, goes to it whole, as the tokenizer finds these before all else.
"""

from __future__ import annotations

import re
from itertools import accumulate, chain

import numpy as np

from . import common

#: ASCII marks but the apostrophe: a run of them that ends a chunk is a pre-token of its own after what LETTER_END ends.
MARKS = bytes(x for x in range(33, 127) if not chr(x).isalnum() and x != 39)
#: The last letter, ASCII or of Latin-1, or digit of a chunk.
LETTER_END = re.compile(rb"(?:[A-Za-z0-9]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])\Z")
#: Chunks of such letters alone: one pre-token each, whatever the normaliser does to them.
LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+\Z")
#: First bytes of the combining marks that an ASCII letter can compose with.
COMBINING = re.compile(rb"\xcc|\xcd[\x80-\xaf]")

#: Chunks in each of the two generations of a worker's memo; when the younger is full, it becomes the elder.
MEMO_CHUNKS = 450_000
#: Bytes of texts that are split at once; bounds the chunks held.
SPLIT_BYTES = 2 << 20
#: Distinct chunks encoded in one call.
CALL_CHUNKS = 2048


class ChunkEncoder:
    """ids of a text as little-endian unsigned bytes, ``dtype`` wide."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # for chunks: a chunk put in lower case may look like an added token that its text doesn't hold
        self.tokenizer.encode_special_tokens = True
        self.added = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        normal = self.tokenizer.normalizer
        self.lowers = normal is not None and normal.normalize_str("Ab") == "ab"
        self.memo: dict[bytes, bytes] = {}
        self.elder: dict[bytes, bytes] = {}

    def _learn(self, chunks: list[bytes]) -> None:
        """Chunks of letters go as one line of words, others as words of their own: the latter is slower but holds for all."""
        lines, others = [], []
        for c in chunks:
            (lines if LETTERS.match(c) else others).append(c)
        for own, apart in ((lines, False), (others, True)):
            for k in range(0, len(own), CALL_CHUNKS):
                part = own[k : k + CALL_CHUNKS]
                if apart:
                    got = self.tokenizer.encode([x.decode("utf-8", "replace") for x in part], is_pretokenized=True, add_special_tokens=False)
                else:
                    got = self.tokenizer.encode(b" ".join(part).decode("utf-8"), add_special_tokens=False)
                ids = np.asarray(got.ids, dtype=self.dtype)
                ends = np.searchsorted(np.asarray(got.word_ids, np.int64), np.arange(len(part) + 1), side="left") * self.dtype.itemsize
                raw, ends = ids.tobytes(), ends.tolist()
                self.memo.update((chunk, raw[a:z]) for chunk, a, z in zip(part, ends, ends[1:]))

    def _chunks(self, text: bytes) -> list[bytes]:
        """Put in lower case first if the tokenizer does so anyway and no letter could compose differently then."""
        if self.lowers and (text.isascii() or not COMBINING.search(text)):
            text = text.lower()
        return text.split()

    def _recall(self, chunks: set[bytes]) -> None:
        """Puts these into the memo: from the elder generation, from their two parts, or encoded."""
        memo, elder = self.memo, self.elder
        old = elder.keys() & chunks
        memo.update(zip(old, map(elder.__getitem__, old)))
        parts, new = [], set()
        for c in chunks - old:
            stem = c.rstrip(MARKS)
            if stem and len(stem) < len(c) and LETTER_END.search(stem):
                parts.append((c, stem, c[len(stem) :]))
                for x in parts[-1][1:]:
                    if x not in memo:
                        if (known := elder.get(x)) is None:
                            new.add(x)
                        else:
                            memo[x] = known
            else:
                new.add(c)
        self._learn(list(new))
        for c, stem, marks in parts:
            memo[c] = memo[stem] + memo[marks]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """A null text counts as empty; empty gives no ids."""
        out: list[bytes] = []
        first = size = 0
        for k, t in enumerate(texts):
            size += len(t) if t else 0
            if size >= SPLIT_BYTES or k == len(texts) - 1:
                out += self._encode(texts[first : k + 1])
                first, size = k + 1, 0
        return out

    def _whole(self, text: bytes) -> bytes:
        self.tokenizer.encode_special_tokens = False
        try:
            return np.asarray(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        finally:
            self.tokenizer.encode_special_tokens = True

    def _encode(self, texts: list[bytes | None]) -> list[bytes]:
        whole = {k: self._whole(t) for k, t in enumerate(texts) if t and any(x in t for x in self.added)}
        split = [self._chunks(t) if t and k not in whole else [] for k, t in enumerate(texts)]
        if len(self.memo) > MEMO_CHUNKS:
            self.memo, self.elder = {}, self.memo
        ends = list(accumulate(map(len, split)))
        flat = list(chain.from_iterable(split))
        got = list(map(self.memo.get, flat))
        if None in got:
            missing = [k for k, x in enumerate(got) if x is None]
            self._recall({flat[k] for k in missing})
            memo = self.memo
            for k in missing:
                got[k] = memo[flat[k]]
        out = [b"".join(got[a:z]) for a, z in zip([0, *ends], ends)]
        for k, ids in whole.items():
            out[k] = ids
        return out


def encoder(path: str) -> ChunkEncoder:
    """One per worker process and file."""
    return common.held(("words", path), lambda: ChunkEncoder(path))
