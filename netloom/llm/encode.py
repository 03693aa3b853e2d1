"""Whole-text encoding with a tokenizers file, one call of the library per distinct word.

A tokenizer whose pre-tokenizer drops white space and never looks across it
gives a text the ids of its words, one after the other.  For such a file
(`Encoder` probes it) each worker keeps the ids of the words it has met in
sorted numpy arrays, and only new words go to the library.  Any other file
gets whole texts.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from . import text as T

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Separators that every notion of white space includes.
_PLAIN = np.ones(256, bool)
_PLAIN[[0x20, 0x09, 0x0A, 0x0D]] = False
#: Words that a worker keeps; the first met stay, as frequent words come early.
KEPT_WORDS = 600_000
_PUNCTUATION = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
_encoders: dict[tuple[str, bool], Encoder] = {}


def word_tokenizer() -> str:
    """The path of the public tokenizer that the queries take."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str, spans: bool = False) -> Encoder:
    """The worker's encoder of a file."""
    if (path, spans) not in _encoders:
        _encoders[path, spans] = Encoder(path, spans)
    return _encoders[path, spans]


def _ragged(at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions at[i] .. at[i] + lengths[i] - 1 of all i, on end."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - ends + lengths, lengths)


class Encoder:
    def __init__(self, path: str, spans: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spans = spans
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        ends = np.zeros(self.size, bool)
        ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.ends = ends
        self.by_word = bool(ends.any()) and self._drops_space()
        # word hashes in order, and for each its run in the flat arrays
        self.hashes = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.flat = [np.zeros(0, t) for t in (np.uint32, np.int32, np.int32)]

    def _drops_space(self) -> bool:
        one = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        words = ["Ab", "c'll", "d,", "9x", "é", "́e", "<|", "|>", "ab</w>"]
        return all(one(sep.join(words)) == sum(map(one, words), []) for sep in (" ", "\n", "\t", "\r", "  \n"))

    def _pretokens(self, word: str) -> int:
        """1 or 2 where that is sure, else 0."""
        stem = word.rstrip(_PUNCTUATION)
        if stem and max(stem) < "ɐ" and stem.lower().isalpha():
            return 1 + (len(stem) < len(word))
        return 0

    def _library(self, words: list[str]) -> list[tuple]:
        """(ids, starts, ends) of each word, from the library; starts and ends are characters of the word."""
        call = self.tokenizer.encode_batch if self.spans else self.tokenizer.encode_batch_fast
        out: list = [None] * len(words)

        def parts(e):
            off = np.array(e.offsets, np.int32).reshape(-1, 2) if self.spans else np.zeros((len(e.ids), 2), np.int32)
            return np.array(e.ids, np.uint32), off

        counts = [self._pretokens(w) for w in words]
        sure = [i for i, c in enumerate(counts) if c]
        chunks = [sure[a : a + 1000] for a in range(0, len(sure), 1000)]
        alone = [i for i, c in enumerate(counts) if not c]
        for chunk, e in zip(chunks, call([" ".join([words[i] for i in c]) for c in chunks], add_special_tokens=False)):
            ids, off = parts(e)
            done = np.flatnonzero(self.ends[ids]) + 1
            last = np.cumsum([counts[i] for i in chunk])
            if len(done) != last[-1] or done[-1] != len(ids):
                alone += chunk
                continue
            cut = np.concatenate([[0], done[last - 1]])
            begin = np.concatenate([[0], np.cumsum([len(words[i]) + 1 for i in chunk])]).astype(np.int32)
            for j, i in enumerate(chunk):
                a, b = cut[j], cut[j + 1]
                out[i] = ids[a:b], off[a:b, 0] - begin[j], off[a:b, 1] - begin[j]
        for i, e in zip(alone, call([words[i] for i in alone], add_special_tokens=False)):
            ids, off = parts(e)
            out[i] = ids, off[:, 0], off[:, 1]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
        """Tokens of each row, and flat ids (with `spans`, also the tokens' first and end characters in the text)."""
        if not self.by_word:
            found = self.tokenizer.encode_batch([x or "" for x in texts.to_pylist()], add_special_tokens=False)
            pairs = np.array([p for e in found for p in e.offsets], np.int64).reshape(-1, 2)
            return np.array([len(e.ids) for e in found], np.int64), [np.array([i for e in found for i in e.ids], np.uint32), pairs[:, 0], pairs[:, 1]]
        w = T.Words(texts, _PLAIN)
        unique, where, code = np.unique(w.hash, return_index=True, return_inverse=True)
        slot = np.minimum(np.searchsorted(self.hashes, unique), max(0, len(self.hashes) - 1))
        known = self.hashes[slot] == unique if len(self.hashes) else np.zeros(len(unique), bool)
        at, length = np.zeros(len(unique), np.int64), np.zeros(len(unique), np.int64)
        at[known], length[known] = self.at[slot[known]], self.length[slot[known]]
        flat = self.flat
        new = np.flatnonzero(~known)
        if len(new):
            got = self._library([w.word(i).decode("utf-8", "replace") for i in where[new]])
            length[new] = [len(g[0]) for g in got]
            at[new] = len(flat[0]) + np.cumsum(length[new]) - length[new]
            flat = [np.concatenate([f, *(g[j] for g in got)]) for j, f in enumerate(flat)] if self.spans else [np.concatenate([flat[0], *(g[0] for g in got)]), *flat[1:]]
            if len(self.hashes) + len(new) <= KEPT_WORDS:
                put = np.searchsorted(self.hashes, unique[new])
                self.hashes = np.insert(self.hashes, put, unique[new])
                self.at, self.length = np.insert(self.at, put, at[new]), np.insert(self.length, put, length[new])
                self.flat = flat
        each = length[code]
        pick = _ragged(at[code], each)
        ends = np.concatenate([[0], np.cumsum(each)])
        counts = np.diff(ends[w.first])
        out = [flat[0][pick]]
        if self.spans:
            # characters before each word in its text: bytes that don't continue a character
            lead = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
            begin = np.repeat(lead[w.starts] - lead[w.at[w.row]], each)
            out += [flat[1][pick] + begin, flat[2][pick] + begin]
        return counts, out
