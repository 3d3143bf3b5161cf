"""SentencePiece models run by the tokenizers library.

The model's protobuf is parsed here; normaliser, white-space marker, pieces, scores
and byte fallback are rebuilt as a tokenizers pipeline: a Unigram model from its
scores, or a BPE model whose merges follow from the scores of the merged pieces.

No piece has the marker after another character, so a text falls into independent
chunks, each beginning with a run of markers. Distinct chunks of a block are encoded as
multithreaded batches, those that a worker still knows from earlier blocks are looked up
in an Arrow array, and documents are assembled by array gathers.

Where two Unigram segmentations score exactly the same (c|cc and cc|c) the library's
choice may differ from sentencepiece's; ``verify`` reports such a text as no parity.
"""

from __future__ import annotations

import os
import struct
import zlib
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import blocks, gather, release, text_or_empty

MARK = "▁"
#: Splits chunks in a batch; a text that holds it is encoded by itself.
_SEP = "﷐"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE, WORD, CHAR = 1, 2, 3, 4


def _fields(data: bytes):
    """(number, value) of a protobuf message's fields; varints as int, others as bytes."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            if kind == 2:
                size, i = varint(i)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind} in a model file")
            value, i = data[i : i + size], i + size
        yield key >> 3, value


@dataclass
class Model:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    suffix_marker: bool = False

    @classmethod
    def parse(cls, data: bytes) -> Model:
        m = cls()
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                m.pieces.append((own[1].decode(), score, own.get(3, NORMAL)))
            elif number == 2:
                own = dict(_fields(value))
                m.kind = own.get(3, UNIGRAM)
                m.byte_fallback = bool(own.get(35, 0))
                m.unk_id = own.get(40, 0)
                m.suffix_marker = bool(own.get(24, 0))
            elif number == 3:
                own = dict(_fields(value))
                m.charsmap = own.get(2, b"")
                m.dummy_prefix = bool(own.get(3, 1))
                m.squeeze = bool(own.get(4, 1))
                m.escape = bool(own.get(5, 1))
        if m.kind not in (UNIGRAM, BPE) or m.suffix_marker or not m.escape:
            raise ValueError("only Unigram and BPE models with a leading marker are rebuilt")
        return m

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, the best-scored result first."""
        score = {p: s for p, s, t in self.pieces if t in (NORMAL, USER)}
        found = []
        for i, (p, s, t) in enumerate(self.pieces):
            if t in (NORMAL, USER):
                found += [(-s, i, k, p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in score and p[k:] in score]
        return [(a, b) for *_, a, b in sorted(found)]

    def _lattice(self) -> list[tuple[str, float]]:
        """Pieces and scores of a Unigram model. Control, unknown, unused and byte pieces
        keep their ids under names with a space, which no normalised text holds, so text that
        spells them is ordinary text. User-defined pieces score so that they always win."""
        top = max((s for _, s, t in self.pieces if t == NORMAL), default=0.0)
        score = {NORMAL: lambda p, s: s, USER: lambda p, s: len(p.encode()) * top - 0.1}
        # a score of theirs must not become the least, from which that of the unknown follows
        return [(p, score[t](p, s)) if t in score else (f" {i}", top) for i, (p, s, t) in enumerate(self.pieces)]

    def tokenizer(self):
        """The tokenizers pipeline: normaliser, marker and model."""
        from tokenizers import Regex, Tokenizer, models, normalizers

        unk = self.pieces[self.unk_id][0]
        if self.kind == UNIGRAM:
            model = models.Unigram(self._lattice(), self.unk_id, False)
        else:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            model = models.BPE(vocab, self.merges(), unk_token=unk, fuse_unk=True, byte_fallback=self.byte_fallback)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        steps.append(normalizers.Replace(" ", MARK))
        out = Tokenizer(model)
        out.normalizer = normalizers.Sequence(steps)
        return out


class Codec:
    """Encoder and decoder of one model file. Of the known chunks, beyond ``most`` bytes with
    their ids, those met in one block only are forgotten, and the seldom met down to half."""

    def __init__(self, path: str, threads: int = 1, most: int = 16 << 20):
        # read when the library starts its pool
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model = Model.load(path)
        self.whole = self.model.tokenizer()
        self.part = self.model.tokenizer()
        self.part.normalizer = None
        # known chunks, their ids in a row, how many ids each has, in how many later blocks each was met
        self.known = pa.array([], pa.large_string())
        self.flat, self.sizes, self.hits = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.most = most
        inner = [p for p, _, t in self.model.pieces if t in (NORMAL, USER) and MARK in p.lstrip(MARK)]
        # Unigram scores are compared over the whole text, but no piece spans two chunks either
        self.by_chunk = not inner and not self.model.charsmap and not self.model.squeeze
        # of a Unigram model the bytes of unknown parts are put in here
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.model.pieces) if t == BYTE} if self.model.kind == UNIGRAM and self.model.byte_fallback else {}
        self.table = []
        for p, _, t in self.model.pieces:
            if t == BYTE:
                self.table.append(bytes([int(p[3:5], 16)]))
            elif t in (CONTROL, UNUSED):
                self.table.append(b"")
            elif t == UNKNOWN:
                self.table.append(" ⁇ ".encode())
            else:
                self.table.append(p.replace(MARK, " ").encode())

    def _batch(self, tokenizer, texts: list[str], rows: int):
        """Encodings of ``texts``, made for so many at once: the library's are large."""
        # the fast way does not say what the unknown parts are
        some = tokenizer.encode_batch if self.bytes else tokenizer.encode_batch_fast
        for at in range(0, len(texts), rows):
            yield from some(texts[at : at + rows], add_special_tokens=False)

    def _ids(self, encoding) -> list[int]:
        if not self.bytes or self.model.unk_id not in encoding.ids:
            return encoding.ids
        out: list[int] = []
        for i, part in zip(encoding.ids, encoding.tokens, strict=True):
            out += [self.bytes[b] for b in part.encode()] if i == self.model.unk_id else [i]
        return out

    def _forget(self) -> None:
        if self.known.nbytes + self.flat.nbytes <= self.most:
            return
        widths = np.asarray(pc.binary_length(self.known)).astype(np.int64) + 8 + 4 * self.sizes
        often = np.argsort(-self.hits, kind="stable")
        stays = np.zeros(len(often), bool)
        stays[often] = (np.cumsum(widths[often]) <= self.most // 2) & (self.hits[often] > 0)
        self.flat = self.flat[np.repeat(stays, self.sizes)]
        self.known, self.sizes, self.hits = self.known.filter(pa.array(stays)), self.sizes[stays], self.hits[stays] // 2

    def _chunks(self, vocab: pa.Array) -> np.ndarray:
        """Places of distinct chunks among the known ones, after encoding those that were not."""
        found = pc.index_in(vocab, value_set=self.known)
        missing = np.asarray(pc.is_null(found).to_numpy(zero_copy_only=False), bool)
        places = np.asarray(pc.fill_null(found, 0)).astype(np.int64)
        self.hits[places[~missing]] += 1
        places[missing] = len(self.known) + np.arange(np.count_nonzero(missing))
        if missing.any():
            new = vocab.filter(pa.array(missing))
            texts, flat, sizes = new.to_pylist(), [], []
            # of the library's objects and lists only one part's are there at a time
            for at in range(0, len(texts), 16_384):
                ids = [self._ids(e) for e in self._batch(self.part, texts[at : at + 16_384], 16_384)]
                sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
                flat.append(np.fromiter(chain.from_iterable(ids), "<u4", int(sizes[-1].sum())))
            self.known = pa.concat_arrays([self.known, new])
            self.flat, self.sizes = np.concatenate([self.flat, *flat]), np.concatenate([self.sizes, *sizes])
            self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int64)])
        return places

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text (null: none)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.asarray(pc.match_substring(texts, _SEP).to_numpy(zero_copy_only=False), bool)
        plain = np.flatnonzero(~odd) if self.by_chunk else np.zeros(0, np.int64)
        out: list = [None] * len(texts)
        if len(plain):
            own = texts if len(plain) == len(texts) else texts.take(pa.array(plain))
            marked = pc.replace_substring(own, " ", MARK)
            if self.model.dummy_prefix:
                marked = pc.if_else(pc.equal(marked, ""), marked, pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), marked, pa.scalar("", pa.large_string())))
            # a separator before every run of markers, by plain replacements; two passes join all of a run
            marked = pc.replace_substring(marked, MARK, _SEP + MARK)
            for _ in range(2):
                marked = pc.replace_substring(marked, MARK + _SEP + MARK, MARK + MARK)
            lists = pc.split_pattern(marked, _SEP)
            coded = lists.flatten().dictionary_encode()
            places = self._chunks(coded.dictionary)
            ends = np.asarray(lists.offsets).astype(np.int64)
            made = gather(self.flat, self.sizes, places[np.asarray(coded.indices)], ends - ends[0])
            self._forget()
            for at, x in zip(plain.tolist(), made, strict=True):
                out[at] = x
        rest = [i for i, x in enumerate(out) if x is None]
        if rest:
            found = self._batch(self.whole, [t or "" for t in texts.take(pa.array(rest)).to_pylist()], 64)
            for at, e in zip(rest, found, strict=True):
                # the pipeline would put a marker before an empty text
                out[at] = np.array(self._ids(e) if texts[at].as_py() else [], "<u4")
        return out

    def decode(self, ids) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.table.__getitem__, ids))
        if self.model.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_CODECS: dict[tuple[str, int], Codec] = {}


def codec(path: str, threads: int = 1) -> Codec:
    """One codec for each worker process and model, kept between tasks."""
    if (path, threads) not in _CODECS:
        _CODECS[path, threads] = Codec(path, threads)
    return _CODECS[path, threads]


def encode(docs: DataFrame, path: str, threads: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``ids``. Null or empty text has no ids; repeated rows give equal
    results; an empty table gives an empty result; other columns are ignored."""
    kind = dict(docs.dtypes)[id_col]

    def of(batches):
        c = codec(path, threads)
        for b in blocks(batches):
            ids = c.encode(b.column(1))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "ids"])

    made = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t")).mapInArrow(of, f"id {kind}, ids array<int>")
    return made.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and ``text``. Null ids give empty text; ids outside the model raise."""
    kind = dict(encoded.dtypes)[id_col]

    def of(batches):
        c = codec(path)
        for b in blocks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    made = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(of, f"id {kind}, text string")
    return made.withColumnRenamed("id", id_col)


def verify(docs: DataFrame, path: str, threads: int = 2, parity: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_ids``, ``ids_crc32`` (little-endian unsigned 32-bit ids),
    ``round_trip`` (the decoded ids are the text) and ``parity`` (the sentencepiece
    library gives the same ids; null unless asked for). Whole texts, every row, repeated
    ones too. Null and empty texts have no ids and both hold; an empty table gives an empty
    result; other columns are ignored. Batches are encoded by ``threads`` threads."""
    kind = dict(docs.dtypes)[id_col]

    def of(batches):
        c = codec(path, threads)
        other = None
        if parity:
            import sentencepiece

            other = sentencepiece.SentencePieceProcessor(model_file=path)
        for b in blocks(batches, 4 << 20):
            texts, ids, same, whole = b.column(1).to_pylist(), c.encode(b.column(1)), [], []
            # Python's lists of ids take ten times the text, so few rows have them at a time
            rows = max(1, b.num_rows * (1 << 19) // max(b.nbytes, 1))
            for at in range(0, b.num_rows, rows):
                some, lists = texts[at : at + rows], [x.tolist() for x in ids[at : at + rows]]
                same += [a == x for a, x in zip(other.encode(some, num_threads=threads), lists, strict=True)] if parity else [None] * len(some)
                whole += [c.decode(x) == t for x, t in zip(lists, some, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    pa.array(whole, pa.bool_()), pa.array(same, pa.bool_()),
                ],
                names=["id", "n_ids", "ids_crc32", "round_trip", "parity"],
            )
        release()

    made = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    made = made.mapInArrow(of, f"id {kind}, n_ids long, ids_crc32 long, round_trip boolean, parity boolean")
    return made.withColumnRenamed("id", id_col)
