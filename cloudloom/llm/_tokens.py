"""Token ids of whole texts, with each distinct piece of a word encoded once.

A pre-token never crosses the cut before a space that has a non-space on either side (byte-level vocabularies), or any
ASCII white space (word vocabularies, which drop it), nor the cuts between a Latin letter and one of ``MARKS``, of these and a letter, or around a lone line feed.
So a text's ids are its pieces' ids in order; pieces are encoded once for a batch, and frequent ones once for a worker. Texts
with other runs of white space are encoded whole.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cloudloom.llm import _text as T

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
CACHED = 400_000  # pieces kept: the first half as they are met, the others when they are met again
SPECIAL = "<|"
SEEN = 1 << 22  # places of the table of words that were met once
ODD_SPACES = r"[\s\v\x{85}\p{Z}] (?:[\s\v\x{85}\p{Z}]|$)"
MARKS = r"[.,;:!?&$%*#<>|()\"/=+_-]"
CUT = "\x1f"
LATIN = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]"  # letters that stay one letter in lower case and any normal form
CUTS = ((rf"({LATIN})({MARKS})", rf"\1{CUT}\2"), (rf"({MARKS})(\p{{L}})", rf"\1{CUT}\2"), (r"([^\s\v\x{85}\p{Z}])\n([^\s\v\x{85}\p{Z}])", rf"\1{CUT}" + "\n" + rf"{CUT}\2"))


def vocabulary_path(name: str) -> str:
    """Where a file of the installed public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Ids of pieces of text, each with ``before`` put before it; of those kept, known from batch to batch."""

    def __init__(self, encoded, before: str):
        self.encoded, self.before = encoded, before
        self.known = pa.array([], pa.large_string())
        self.seen = np.zeros(SEEN, bool)
        self.ids = np.empty(1 << 16, np.uint32)
        self.ends = np.zeros(CACHED + 1, np.int64)

    def of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and each piece's begin and end in it."""
        codes, words = T.coded(pieces)
        n = len(self.known)
        at = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        missed = words.take(pa.array(new))
        strings = missed.to_pylist()
        lengths, ids = self.encoded([self.before + w for w in strings] if self.before else strings)
        base = int(self.ends[n])
        begin, end = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        ends = np.cumsum(lengths)
        old = at >= 0
        begin[old], end[old] = self.ends[at[old]], self.ends[at[old] + 1]
        begin[new], end[new] = base + ends - lengths, base + ends
        pool = np.concatenate([self.ids[:base], ids])
        if n < CACHED and len(new):
            if n < CACHED // 2:
                again = np.arange(len(new))
            else:
                place = np.fromiter(map(hash, strings), np.int64, len(strings)) & (SEEN - 1)
                again = np.flatnonzero(self.seen[place])
                self.seen[place] = True
            again = again[: CACHED - n]
            if len(again):
                keep = gathered(ids, (ends - lengths)[again], lengths[again])
                while base + len(keep) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
                self.ids[base : base + len(keep)] = keep
                self.ends[n + 1 : n + 1 + len(again)] = base + np.cumsum(lengths[again])
                self.known = pa.concat_arrays([self.known, missed.take(pa.array(again))])
        return pool, begin[codes], end[codes]


class Encoder:
    def __init__(self, path: str, by_words: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = by_words
        self.stop_id, added = min(self.tokenizer.get_added_tokens_decoder().items())
        self.stop = added.content
        self.bare = Pieces(self.encoded, "")
        self.spaced = self.bare if by_words else Pieces(self.encoded, " ")

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of texts, each encoded by itself.

        Texts go to the library twenty at a time, with its special token, which no merge crosses, after each; a text that
        may hold the token's string goes alone.
        """
        if not texts:
            return np.empty(0, np.int64), np.empty(0, np.uint32)
        if any(SPECIAL in t for t in texts):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            return lengths, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        joined = [self.stop.join(texts[i : i + 20]) + self.stop for i in range(0, len(texts), 20)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), np.uint32, sum(map(len, found)))
        stops = np.flatnonzero(ids == self.stop_id)
        return np.diff(stops, prepend=-1) - 1, ids[ids != self.stop_id]

    def words(self, words: pa.Array, first: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """(ends, ids) of words, whose first pieces are among ``first`` and whose others are bare."""
        whole = pc.or_(pc.match_substring(words, CUT), pc.match_substring(words, SPECIAL))
        cut = words
        for pattern, by in CUTS[: 2 if self.by_words else 3]:
            cut = pc.replace_substring_regex(cut, pattern, by)
        lists = pc.split_pattern(pc.if_else(whole, "", cut), CUT)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        pieces = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        if pc.any(whole).as_py():  # words that hold the mark of a cut, or perhaps a special token: one piece each
            at = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
            pieces = pc.replace_with_mask(pieces, pa.array(np.isin(np.arange(len(pieces)), offsets[:-1][at])), words.take(pa.array(at)))
        head = np.zeros(len(pieces), bool)
        head[offsets[:-1]] = True
        begin, end = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        pool, begin[head], end[head] = first.of(pieces.filter(pa.array(head)))
        more, b, e = self.bare.of(pieces.filter(pa.array(~head)))
        begin[~head], end[~head] = len(pool) + b, len(pool) + e
        return np.concatenate([[0], np.cumsum(end - begin)])[offsets], gathered(np.concatenate([pool, more]), begin, end - begin)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ends, ids): ids of text i are ``ids[ends[i]:ends[i + 1]]``."""
        if self.by_words:
            odd = np.zeros(len(texts), bool)
            lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, SPECIAL), texts, pc.ascii_lower(texts)))  # the vocabulary's own first step
        else:
            odd = pc.match_substring_regex(texts, ODD_SPACES).to_numpy(zero_copy_only=False)
            lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        codes, names = T.coded(flat)
        ends, pool = self.words(names, self.spaced)
        begin, end = ends[codes], ends[codes + 1]
        if not self.by_words:  # no space before a text's first word
            first = offsets[:-1][np.diff(offsets) > 0]
            heads, where = np.unique(codes[first], return_inverse=True)
            ends, more = self.words(names.take(pa.array(heads)), self.bare)
            begin[first], end[first] = len(pool) + ends[where], len(pool) + ends[where + 1]
            pool = np.concatenate([pool, more])
        n = end - begin
        if not odd.any():
            return np.concatenate([[0], np.cumsum(n)])[offsets], gathered(pool, begin, n)
        n = np.where(np.repeat(odd, np.diff(offsets)), 0, n)
        total = np.diff(np.concatenate([[0], np.cumsum(n)])[offsets])
        total[odd], whole_ids = self.encoded([texts[int(i)].as_py() for i in np.flatnonzero(odd)])
        ends = np.concatenate([[0], np.cumsum(total)])
        out = np.empty(ends[-1], np.uint32)
        keep = np.repeat(~odd, total)
        out[keep] = gathered(pool, begin, n)
        out[~keep] = whole_ids
        return ends, out


def gathered(pool: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Runs of ``pool`` one after another."""
    if not len(n):
        return np.empty(0, np.uint32)
    shift = begin - (np.cumsum(n) - n)
    return pool[np.repeat(shift, n) + np.arange(int(n.sum()))]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, by_words: bool) -> Encoder:
    """The worker's encoder for a file: its words stay known from task to task."""
    if (path, by_words) not in _encoders:
        _encoders[path, by_words] = Encoder(path, by_words)
    return _encoders[path, by_words]
