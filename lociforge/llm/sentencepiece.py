"""SentencePiece models encoded and decoded with the tokenizers library.

The model file is parsed from its protobuf; normaliser, metaspace marker, scores (unigram
models) or merges (BPE models) and byte fallback are rebuilt. Batches of whole texts go to
the library's threads; the ids of every text are compared with those of the sentencepiece
library and decoded again through the table of pieces.

Where no piece of the model has a marker after another character, a very long text is encoded
in runs that begin with a space, which bounds the memory it takes.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lociforge.llm.wordcache import plain, slices

MARK = "▁"
#: Characters of a text from which on it is encoded in runs of about as many.
LONG = 1 << 18
#: Numbers of fields and kinds of pieces in the protobuf of a model.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_UNIGRAM, _BPE = 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield number, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)  # piece, score, kind
    kind: int = _UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m = cls()
        for number, value in _fields(data):
            if number == _PIECES:
                own = dict(_fields(value))
                m.pieces.append((own.get(1, b"").decode(), own.get(2, 0.0), own.get(3, _NORMAL)))
            elif number == _TRAINER:
                own = dict(_fields(value))
                m.kind, m.byte_fallback = own.get(3, _UNIGRAM), bool(own.get(35, 0))
            elif number == _NORMALIZER:
                own = dict(_fields(value))
                m.charsmap, m.dummy_prefix, m.remove_extra = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1))
        return m

    def of(self, kind: int) -> list[int]:
        return [i for i, p in enumerate(self.pieces) if p[2] == kind]

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, best score first."""
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (_NORMAL, _USER, _UNUSED)}
        found = []
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if a in ids and b in ids:
                    found.append((-self.pieces[i][1], i, ids[a], ids[b], a, b))
        return [x[4:] for x in sorted(found)]

    def splits_at_marks(self) -> bool:
        """Whether texts can be encoded in pieces cut before runs of markers."""
        inside = any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (_NORMAL, _USER))
        return not inside and not self.charsmap and not self.remove_extra and self.dummy_prefix and self.kind == _BPE

    def tokenizer(self, prefix: bool = True):
        """The model in the tokenizers library; without prefix it takes pieces that begin with a space."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        unknown = (self.of(_UNKNOWN) or [0])[0]
        if self.kind == _UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=unknown, byte_fallback=self.byte_fallback)
        elif self.kind == _BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            model = models.BPE(vocab, self.merges(), unk_token=self.pieces[unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model type {self.kind}")
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.remove_extra:
            steps += [normalizers.Strip(left=True, right=True), normalizers.Replace(Regex(" {2,}"), " ")]
        steps += [normalizers.Prepend(MARK)] if self.dummy_prefix and prefix else []
        out = Tokenizer(model)
        out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        strip = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
        return out


def runs_of(text: str, size: int = LONG) -> list[str]:
    """text in runs of ``size`` characters or a little more; all but the first begin with a space and go on with none."""
    cuts, at = [0], size
    while at < len(text):
        at = text.find(" ", at)
        while 0 <= at < len(text) - 1 and (text[at + 1] == " " or text[at - 1] == " "):
            at = text.find(" ", at + 1)
        if at < 0 or at >= len(text) - 1:
            break
        cuts.append(at)
        at += size
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


class Codec:
    """Encodes and decodes texts by a model file, and compares the ids with those of the sentencepiece library."""

    def __init__(self, path: str, data: bytes | None = None, long: int = LONG):
        import sentencepiece

        os.environ.setdefault("RAYON_NUM_THREADS", "2")  # threads of a batch; a task's neighbours have their own
        self.model = Model.parse(data or open(path, "rb").read())
        self.whole = self.model.tokenizer()
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=data) if data else sentencepiece.SentencePieceProcessor(model_file=path)
        self.long = long if self.model.splits_at_marks() else None
        self.later = None  # for runs after the first, when there are any
        byte = {i: bytes([int(p[3:5], 16)]) for i, (p, _, kind) in enumerate(self.model.pieces) if kind == _BYTE}
        byte |= {i: "\ufffd".encode() for i in self.model.of(_UNKNOWN)}
        self.table = pa.array([byte.get(i, p.replace(MARK, " ").encode()) for i, (p, _, _) in enumerate(self.model.pieces)], pa.large_binary())

    def _encode_long(self, text: str) -> tuple[list[int], bool]:
        first, *rest = runs_of(text, self.long)
        self.later = self.later or self.model.tokenizer(prefix=False)
        own = [self.whole.encode(first, add_special_tokens=False).ids]
        plain = [self.plain.encode(first)]
        for run in rest:
            own.append(self.later.encode(run, add_special_tokens=False).ids)
            plain.append(self.plain.encode(run[1:]))  # sentencepiece adds the space itself
        return [i for x in own for i in x], own == plain

    def encode(self, texts: list[str]) -> tuple[list[list[int]], np.ndarray]:
        """The ids of each text, and whether sentencepiece gives the same."""
        long = [k for k, x in enumerate(texts) if self.long and len(x) > self.long]
        short = [x for x in texts if not (self.long and len(x) > self.long)] if long else texts
        ids = [x.ids for x in self.whole.encode_batch_fast(short, add_special_tokens=False)]
        same = [a == b for a, b in zip(ids, self.plain.encode(short, num_threads=1), strict=True)]
        for k in long:
            own, agreed = self._encode_long(texts[k])
            ids.insert(k, own)
            same.insert(k, agreed)
        return ids, np.array(same, bool)

    def decode(self, flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The UTF-8 texts of the ids, a run of sizes[k] for each: pieces joined, markers as spaces, the first one dropped."""
        if not len(sizes):
            return []
        pieces = self.table.take(pa.array(flat.astype(np.int64)))
        offsets = np.frombuffer(pieces.buffers()[1], np.int64)[: len(pieces) + 1] if len(pieces) else np.zeros(1, np.int64)
        data = memoryview(pieces.buffers()[2])[int(offsets[0]) : int(offsets[-1])] if len(pieces) and pieces.buffers()[2] else memoryview(b"")
        upto = (offsets[np.concatenate([[0], np.cumsum(sizes)])] - offsets[0]).tolist()
        out = [bytes(data[a:b]) for a, b in zip(upto, upto[1:], strict=False)]
        return [x[1:] if x[:1] == b" " else x for x in out] if self.model.dummy_prefix else out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encoded(docs: DataFrame, model: str, text: str = "text", ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip, parity[, ids]) for each row of docs.

    ids_crc32 is that of the ids as little-endian numbers of 32 bits. round_trip: decoding the
    ids of the text gives it back. parity: the sentencepiece library gives the same ids for it.
    Null and empty texts have no ids and come back empty; doc_id may be null or repeated;
    repeated rows are encoded alike; other columns of docs are not read, so their names may be
    any; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for part in slices(batch, text):
                texts = plain(part[text]).to_pylist()
                found, same = own.encode(texts)
                n = np.fromiter(map(len, found), np.int64, len(found))
                flat = np.fromiter((i for x in found for i in x), np.uint32, int(n.sum()))
                del found
                back = [a == b.encode() for a, b in zip(own.decode(flat, n), texts, strict=True)]
                data, upto = memoryview(flat.astype("<u4")).cast("B"), np.concatenate([[0], np.cumsum(n)])
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
                cols = [part["doc_id"], pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(back, pa.bool_()), pa.array(same)]
                names = ["doc_id", "n_tokens", "ids_crc32", "round_trip", "parity"]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean" + ", ids array<int>" * ids
    return docs.select("doc_id", text).mapInArrow(run, schema)
