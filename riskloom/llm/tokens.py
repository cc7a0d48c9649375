"""Token ids of many texts with a public tokenizer file; pieces between spaces are remembered by the Python worker."""

from __future__ import annotations

import os
import sys
import types

import numpy as np

MOST_REMEMBERED = 1_200_000  # about 250 MB
LONGEST_REMEMBERED = 48


def worker_memory(name: str) -> dict:
    """A dictionary that lives as long as this Python process, which Spark uses for many tasks."""
    holder = sys.modules.setdefault("riskloom_worker_memory", types.ModuleType("riskloom_worker_memory"))
    return holder.__dict__.setdefault(name, {})


class Encoder:
    """Texts to little-endian 32-bit ids.

    A byte-level tokenizer of this kind never joins across a single space: the space starts the next piece. So a text
    without two spaces in a row is encoded piece by piece, and equal pieces only once; other texts are encoded whole.
    The strings of special tokens give those tokens, or with ``plain`` the ids of ordinary text.
    """

    def __init__(self, content: str, plain: bool = False, most_remembered: int = MOST_REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker for each core
        from tokenizers import Tokenizer

        loaded = worker_memory("tokenizers")
        if (content, plain) not in loaded:
            tokenizer = Tokenizer.from_str(content)
            tokenizer.encode_special_tokens = plain
            vocabulary = tokenizer.get_vocab()
            sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
            for token, number in vocabulary.items():
                sizes[number] = len(token)  # a character of a byte-level token is a byte
            loaded[content, plain] = tokenizer, sizes
        self.tokenizer, self.token_bytes = loaded[content, plain]
        self.known = worker_memory(f"pieces-{hash(content)}-{plain}")
        self.most_remembered = most_remembered

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _pieces(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word with a space before it.

        Words without white space at their ends are encoded as one text, as the space before each is a sure border; the
        bytes that each token stands for tell where a word's ids end.
        """
        plain = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        other = list(set(words).difference(plain)) if len(plain) < len(words) else []
        out = dict(zip(other, self._encoded([" " + w for w in other]), strict=True)) if other else {}
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            [whole] = self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)
            ids = np.array(whole.ids, dtype="<u4")
            ends = np.cumsum([len(w.encode("utf-8", "surrogatepass")) + 1 for w in part])
            cuts = 4 * (np.searchsorted(np.cumsum(self.token_bytes[ids]), ends) + 1)
            raw, begin = ids.tobytes(), 0
            for word, end in zip(part, cuts.tolist(), strict=True):
                out[word] = raw[begin:end]
                begin = end
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.most_remembered:
            self.known.clear()
        known = self.known
        split = [None if "  " in t else t.split(" ") for t in texts]
        heads = self._encoded([t if s is None else s[0] for t, s in zip(texts, split, strict=True)])
        new = [w for w in set().union(*(s[1:] for s in split if s)) if w not in known]
        fresh = self._pieces(new)
        long = {w: fresh.pop(w) for w in new if len(w) > LONGEST_REMEMBERED}
        known.update(fresh)
        get = known.__getitem__ if not long else lambda w: long[w] if w in long else known[w]
        return [head if s is None else head + b"".join(map(get, s[1:])) for head, s in zip(heads, split, strict=True)]
