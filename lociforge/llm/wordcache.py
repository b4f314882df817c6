"""Encoding of whole texts by their pieces.

Where a tokenizer never joins what stands on two sides of a cut, the ids of a text are those
of its pieces in order. Pieces repeat, so each worker keeps the ids of the pieces it has met;
only new ones go to the tokenizer. The store is emptied when it holds ``limit`` pieces.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20


class PieceEncoder:
    """encode: ids of each of a list of pieces. split: lists of pieces of an array of texts.

    Each of checks judges new pieces and their ids; ``passed`` has for each of them, and for
    each text of the last call, whether all pieces passed it, whenever they were new.
    """

    def __init__(
        self, split: Callable[[pa.Array], pa.Array], encode: Callable[[list[str]], list[list[int]]],
        checks: tuple[Callable[[list[str], list[list[int]]], list[bool]], ...] = (), limit: int = 450_000,
    ):
        self.split, self.encode, self.checks, self.limit = split, encode, checks, limit
        self._empty()

    def _empty(self) -> None:
        self.at: dict[str, int] = {}
        self.start, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0
        self.failed = [np.zeros(1 << 16, bool) for _ in self.checks]

    def _learn(self, pieces: list[str]) -> None:
        found = self.encode(pieces)
        n, k = len(pieces), len(self.at)
        sizes = np.fromiter(map(len, found), np.int64, n)
        total = int(sizes.sum())
        while k + n > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
            self.failed = [np.resize(x, len(self.size)) for x in self.failed]
        if self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, max(2 * len(self.flat), self.used + total))
        self.start[k : k + n] = self.used + np.cumsum(sizes) - sizes
        self.size[k : k + n] = sizes
        for failed, check in zip(self.failed, self.checks, strict=True):
            failed[k : k + n] = ~np.array(check(pieces, found), bool)
        self.flat[self.used : self.used + total] = np.fromiter((i for x in found for i in x), np.uint32, total)
        self.used += total
        self.at.update(zip(pieces, range(k, k + n), strict=True))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts (no nulls), and how many each text has."""
        if len(self.at) > self.limit or self.used > 8 * self.limit:
            self._empty()
        lists = self.split(texts)
        coded = pc.list_flatten(lists).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if new := [w for w in words if w not in self.at]:
            self._learn(new)
        get = self.at
        place = np.fromiter(map(get.__getitem__, words), np.int32, len(words))
        k = place[coded.indices.to_numpy()] if len(words) else np.empty(0, np.int32)
        sizes = self.size[k]
        upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        where = np.repeat((self.start[k] - upto[:-1]).astype(np.int32), sizes)
        where += np.arange(len(where), dtype=np.int32)
        ids = self.flat[where]
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int64)
        self.passed = [np.diff(np.concatenate([[0], np.cumsum(x[k])])[offsets]) == 0 for x in self.failed]
        return ids, np.diff(upto[offsets])


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows with about so many bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes, dtype=np.int64) // size
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def plain(column: pa.Array) -> pa.Array:
    """A string column without nulls."""
    return pc.fill_null(column.cast(pa.string()), "")


#: A run of these between letters, digits or spaces of ASCII is a piece of its own.
_MARKS = r"""([A-Za-z0-9\s])([.,;:!?*#%&$"()/]+)([A-Za-z0-9\s])"""
_BETWEEN = "!"


def _lower_words(texts: pa.Array) -> pa.Array:
    """Texts as lists of words, in lower case and without the marks around them where no special token can be."""
    if not pc.any(pc.match_substring(texts, "<|")).as_py():
        texts = pc.replace_substring_regex(pc.ascii_lower(texts), _MARKS, r"\1 \2 \3")
    return pc.ascii_split_whitespace(texts)


#: Texts on which the ids of pieces must be those of the whole, for a tokenizer that is to be used by pieces.
_PROBES = ["The Quick, brown.Fox (jumped) it's 3.5% A1 b#c", "ÉTÉ\u0301 ﬁn  x\ty\n\nz!!", "don't 'S 12,345 a.b.c $5 é(ß)", " lead and trail "]
_encoders: dict[tuple, PieceEncoder] = {}


def word_encoder(path: str, special: bool = True) -> PieceEncoder:
    """For a tokenizer file that lower-cases, drops white space and cuts at it and at runs of marks; one for each worker.

    special: strings of special tokens in a text are those tokens, as is the library's default.
    """
    if (path, special) not in _encoders:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks share the cores
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = not special
        (between,) = tokenizer.encode(_BETWEEN, add_special_tokens=False).ids

        def one_by_one(words: list[str]) -> list[list[int]]:
            return [x.ids for x in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

        def encode(words: list[str]) -> list[list[int]]:
            """All words as one text, a mark between them: a call for each costs more than its work."""
            joined = [w for w in words if _BETWEEN not in w]
            ids = tokenizer.encode_batch_fast([f" {_BETWEEN} ".join(joined)], add_special_tokens=False)[0].ids if joined else []
            found, own = [], []
            for i in ids:
                if i == between:
                    found.append(own)
                    own = []
                else:
                    own.append(i)
            found.append(own)
            if len(found) != len(joined):
                return one_by_one(words)
            if len(joined) == len(words):
                return found
            rest = iter(one_by_one([w for w in words if _BETWEEN in w]))
            found = iter(found)
            return [next(rest if _BETWEEN in w else found) for w in words]

        own = PieceEncoder(_lower_words, encode)
        ids, n = own(pa.array(_PROBES))
        if [x.ids for x in tokenizer.encode_batch_fast(_PROBES, add_special_tokens=False)] != [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]:
            raise ValueError(f"{path} does not lower-case texts and cut them at white space and marks")
        _encoders[path, special] = own
    return _encoders[path, special]


#: White space of the byte-level pattern, for a class of RE2; marks of pieces, which texts must not hold.
_WHITE = r"\s\x0b\x{85}\p{Z}"
_LITERAL, _CUT = "\x01", "\x02"
#: A space with white space (or the end) on both sides: the pattern may join it with what is before it.
_JOINED = rf"[{_WHITE}] (?:[{_WHITE}]|\z)"
#: Further borders of the pattern: between a letter and a mark, and beside a lone line end.
_MARK, _LINE = r"([A-Za-z])([!-/:-@\[-`{-~])", r"([!-~])(\n)"
_LITERALS = rf"\1 {_LITERAL}\2"
_BEFORE_WHITE = rf"([^{_WHITE}])([{_WHITE}])"
#: Texts that go to the tokenizer whole go in runs of so many characters, cut before a space between ASCII marks, letters or digits.
RUN = 1 << 16
#: New words that go to the tokenizer as one text; its time grows faster than the text.
LINES = 100
_RUN_END = re.compile(r"(?<=[!-~]) (?=[!-~])")


def _runs(text: str) -> list[str]:
    cuts = [0]
    while len(text) - cuts[-1] > RUN and (m := _RUN_END.search(text, cuts[-1] + RUN)):
        cuts.append(m.start())
    return [_LITERAL + text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True) if b > a]


def _byte_pieces(specials: list[str]) -> Callable[[pa.Array], pa.Array]:
    """Pieces of texts for the byte-level pattern; one that begins with _LITERAL stands for what follows it, others for a space and themselves.

    A cut before the first white space of a run is always a border of the pattern. Most texts
    are cut at every space, which is the same unless a space has white space on both sides.
    """

    def split(texts: pa.Array) -> pa.Array:
        n = len(texts)
        whole = np.zeros(n, bool)
        for x in (_LITERAL, _CUT, *specials):
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        joined = ~whole & pc.match_substring_regex(texts, _JOINED).to_numpy(zero_copy_only=False)
        marked = lambda x: pc.binary_join_element_wise(pa.scalar(_LITERAL), x, "")
        finer = lambda x: pc.replace_substring_regex(pc.replace_substring_regex(x, _MARK, _LITERALS), _LINE, _LITERALS)
        if not (whole | joined).any():
            return pc.split_pattern(finer(marked(texts)), " ")
        rows = [np.flatnonzero(x) for x in (~whole & ~joined, joined, whole)]
        plain, cut, rest = (texts.take(pa.array(x)) for x in rows)
        cut = pc.replace_substring_regex(marked(cut), _BEFORE_WHITE, rf"\1{_CUT}{_LITERAL}\2")
        own = pa.array([_runs(x) for x in rest.to_pylist()], pa.list_(pa.string()))
        lists = pa.concat_arrays([pc.split_pattern(finer(marked(plain)), " "), pc.split_pattern(cut, _CUT), own])
        return lists.take(pa.array(np.argsort(np.concatenate(rows), kind="stable")))

    return split


_BYTE_PROBES = [" a", "a  b", "a   b \n\n c", "it's 12 x\u00a0 y  ", "", " ", "\t\tif x:\n        y = 'z'\n", "é\u2028 ß   ", "don't<|endoftext|> stop", "\x01 a\x02b"]


def byte_encoder(path: str) -> PieceEncoder:
    """For a byte-level BPE file with the usual pattern (words with the space before them); one for each worker."""
    if (path, "bytes") not in _encoders:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks share the cores
        tokenizer = Tokenizer.from_file(path)
        specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

        (end,) = tokenizer.encode("\n", add_special_tokens=False).ids

        def one_by_one(pieces: list[str]) -> list[list[int]]:
            texts = [p[1:] if p[:1] == _LITERAL else f" {p}" for p in pieces]
            return [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        def encode(pieces: list[str]) -> list[list[int]]:
            """LINES pieces at a time as lines of a text, whose ends are ids of their own: a call for each costs more than its work."""
            found = []
            for k in range(0, len(pieces), LINES):
                own = pieces[k : k + LINES]
                text = "\n".join([p[1:] if p[:1] == _LITERAL else f" {p}" for p in own])
                spaces = len(own) - sum(p[:1] == _LITERAL for p in own)
                if text.count("\n") < len(own) and text.count(" ") == spaces and text.replace("\n", "").isprintable():  # no other white space
                    ids = tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
                    cuts = [-1, *[j for j, i in enumerate(ids) if i == end], len(ids)]
                    if len(cuts) == len(own) + 1:
                        found += [ids[a + 1 : b] for a, b in zip(cuts, cuts[1:], strict=False)]
                        continue
                found += one_by_one(own)
            return found

        own = PieceEncoder(_byte_pieces(specials), encode, limit=900_000)
        ids, n = own(pa.array(_BYTE_PROBES))
        if [x.ids for x in tokenizer.encode_batch_fast(_BYTE_PROBES, add_special_tokens=False)] != [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]:
            raise ValueError(f"{path} does not cut texts before white space")
        _encoders[path, "bytes"] = own
    return _encoders[path, "bytes"]
