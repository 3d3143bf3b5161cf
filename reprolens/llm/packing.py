"""Best-fit packing of tokenised documents into fixed-length sequences.

Tokenising: a text's ids are the concatenation of the ids of its chunks between
ASCII white space (the tokenizer drops white space and never merges across it),
so each distinct chunk is encoded once per worker and documents are assembled by
array gathers.

Packing: partitions run best-fit decreasing on their pieces, and dual-feasible
functions bound from below how many sequences these pieces need. A partition that
meets its bound is certified and final. The others give up their least full
sequences; the pieces in them are exchanged (grouped anew, fewer groups each
time) and packed again, until every group is certified, one group is left, or an
exchange no longer lessens what is given up. Each sequence says how many sequences
its group took and how many it needs at least.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Words, assemble, blocks, cut, release, text_or_empty

CAPACITY = 4096
#: Pieces of one packing group (about 40 bytes each).
GROUP_ROWS = 20_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def chunked(path: str) -> bool:
    """Whether a tokenizers file's ids of a text are those of its chunks in a row."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)

    def steps(part, many):
        return (part.get(many, []) if part["type"] == "Sequence" else [part]) if part else []

    normal = [(n["type"], str(n.get("pattern", "")), n.get("content")) for n in steps(spec.get("normalizer"), "normalizers")]
    split = steps(spec.get("pre_tokenizer"), "pretokenizers")
    model = spec["model"]
    return (
        model["type"] == "BPE"
        and model.get("end_of_word_suffix") == "</w>"
        and not model.get("continuing_subword_prefix")
        and normal == [("NFC", "", None), ("Replace", "{'Regex': '\\\\s+'}", " "), ("Lowercase", "", None)]
        and [p["type"] for p in split] == ["Split", "ByteLevel"]
        # fixed value: contractions, letter runs, single digits, runs of other marks
        and split[0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        and (split[0]["behavior"], split[0]["invert"]) == ("Removed", True)
        and not (split[1]["add_prefix_space"] or split[1]["use_regex"])
        and all(t["content"].startswith("<") for t in spec.get("added_tokens", []))
    )


class ChunkEncoder:
    """Ids of a tokenizers file for whole batches, one encoding per distinct chunk.

    Chunks are split off by Arrow kernels. In a plain text (ASCII and Latin-1
    letters, no apostrophe, which may begin a contraction, and no '<', which may
    begin a special token) letter runs, digits and other runs are split apart by
    the tokenizer whatever stands next to them, so they are the chunks there. In
    any other text the chunks are what white space separates.
    Known chunks are forgotten when there are over ``most`` of them.

    All this holds for word-end BPE files that lower-case, drop white space and split
    letters, digits and marks (``chunked`` looks for just that); texts for any other
    tokenizer are encoded whole.
    """

    ODD = r"[^\t-\r -&(-;=-~À-ÖØ-öø-ÿ]"
    SPLIT = r"([0-9]|[!-&(-/:;=-@\[-`{-~]+)"

    def __init__(self, path: str, by_chunk: bool, most: int = 40_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.by_chunk = by_chunk
        self.most = most
        self.plain: dict[str, bytes] = {}
        self.other: dict[str, bytes] = {}
        # byte-level alphabet: printable Latin-1 stands for itself, the other bytes for 256 onwards
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        self.alphabet = {b: 256 + i for i, b in enumerate(hidden)}

    def _plain(self, vocab: list[str]) -> list[bytes]:
        if len(self.plain) > self.most:
            self.plain = {}
        known, tokenize, out = self.plain, self.tok.model.tokenize, []
        for c in vocab:
            ids = known.get(c)
            if ids is None:
                raw = c if c.isascii() else c.encode().decode("latin-1").translate(self.alphabet)
                ids = known[c] = array("I", [t.id for t in tokenize(raw)]).tobytes()
            out.append(ids)
        return out

    def _other(self, vocab: list[str]) -> list[bytes]:
        if len(self.other) > self.most // 4:
            self.other = {}
        new = [c for c in vocab if c not in self.other]
        for c, e in zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.other[c] = array("I", e.ids).tobytes()
        return [self.other[c] for c in vocab]

    def _gather(self, texts: pa.Array, encode) -> list[np.ndarray]:
        w = Words(texts, lower=False)
        return assemble(encode(w.vocab.to_pylist()), w.codes, w.starts)

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit arrays."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_chunk:
            return [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        odd = np.asarray(pc.match_substring_regex(texts, self.ODD).to_numpy(zero_copy_only=False), bool)
        out: list = [None] * len(texts)
        for mask, plain in ((~odd, True), (odd, False)):
            rows = np.flatnonzero(mask)
            if not len(rows):
                continue
            own = texts if len(rows) == len(texts) else texts.take(pa.array(rows))
            if plain:
                own = pc.utf8_lower(pc.replace_substring_regex(own, self.SPLIT, r" \1 "))
            for at, ids in zip(rows.tolist(), self._gather(own, self._plain if plain else self._other), strict=True):
                out[at] = ids
        return out


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str, by_chunk: bool) -> ChunkEncoder:
    """One encoder for each worker process, kept between tasks: made anew for each, it
    left more memory behind."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path, by_chunk)
    return _ENCODERS[path]


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32.

    A document is its ids followed by ``end_id``; null or empty text is that id
    alone. Longer documents are cut every ``capacity`` tokens. Rows are taken one
    by one, so repeated identifiers give repeated pieces.
    """

    by_chunk = chunked(tokenizer)

    def cut_up(batches):
        enc = encoder(tokenizer, by_chunk)
        for b in blocks(batches, 1 << 20):
            rows = []
            for d, ids in zip(b.column(0).to_pylist(), enc.batch(b.column(1)), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    rows.append((d, k, at, len(own), zlib.crc32(own.tobytes())))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("t")).mapInArrow(cut_up, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Fewest sequences that any packing needs: the best of two families of
    dual-feasible functions over all their thresholds.

    f_e (0 <= e <= 1/2): 1 above 1-e, 0 below e, else the size itself.
    u_k (k = 1..40): x if (k+1)x is whole, else floor((k+1)x)/k.
    """
    if not len(lengths):
        return 0
    sizes, n = np.unique(np.asarray(lengths, dtype=np.int64), return_counts=True)
    total = sizes * n
    best = -(-int(total.sum()) // capacity)
    sums = np.concatenate([[0], np.cumsum(total)])
    nums = np.concatenate([[0], np.cumsum(n)])
    cuts = np.unique(np.concatenate([sizes[sizes <= capacity // 2], [0]]))
    lo = np.searchsorted(sizes, cuts, "left")
    hi = np.searchsorted(sizes, capacity - cuts, "right")
    value = (nums[-1] - nums[hi]) * capacity + sums[hi] - sums[np.minimum(lo, hi)]
    best = max(best, int(-(-value.max() // capacity)))
    for k in range(1, 41):
        scaled = (k + 1) * sizes
        whole = scaled % capacity == 0
        # in units of 1 / (capacity * k)
        value = np.where(whole, sizes * k, (scaled // capacity) * capacity)
        best = max(best, int(-(-int((value * n).sum()) // (capacity * k))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins. Ties keep their order."""
    order = np.argsort(-np.asarray(lengths), kind="stable")
    bins = np.empty(len(order), np.int64)
    offsets = np.empty(len(order), np.int64)
    room: dict[int, list[int]] = {}  # free space -> bins that have it
    free: list[int] = []  # the keys of room, ascending
    n = 0
    for i, size in zip(order.tolist(), np.asarray(lengths)[order].tolist(), strict=True):
        at = bisect_left(free, size)
        if at < len(free):
            have = free[at]
            b = room[have].pop()
            if not room[have]:
                del room[have], free[at]
        else:
            have, b = capacity, n
            n += 1
        bins[i], offsets[i] = b, capacity - have
        left = have - size
        if left:
            if left not in room:
                room[left] = []
                insort(free, left)
            room[left].append(b)
    return bins, offsets, n


def _packer(capacity: int, last: bool):
    return lambda group: _packed(group, capacity, last)


def _packed(group: pa.Table, capacity: int, last: bool) -> pa.Table:
    """One group packed; ``open`` marks pieces that are to be exchanged."""
    group = group.sort_by([("length", "descending"), ("u", "ascending")])
    lengths = group["length"].to_numpy()
    bins, offsets, n = best_fit_decreasing(lengths, capacity)
    bound = lower_bound(lengths, capacity)
    fill = np.bincount(bins, weights=lengths, minlength=n)
    giving = np.zeros(n, bool)
    if not last and n > bound:
        # the emptiest sequences, and enough others for their pieces to find new places
        giving[np.argsort(fill, kind="stable")[: max(8, 4 * (n - bound))]] = True
        giving[fill < 0.98 * capacity] = True
    elif not last and n:
        # certified here, but one partly filled sequence per group adds up
        giving[np.argmin(fill)] = fill.min() < capacity
    more = {"bin": bins, "offset": offsets, "open": giving[bins], "group_sequences": np.full(len(bins), n), "group_bound": np.full(len(bins), bound)}
    for name, values in more.items():
        group = group.append_column(name, pa.array(values, pa.bool_() if name == "open" else pa.int64()))
    return group


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: best-fit decreasing certified
    group by group, with exchange of the pieces of groups that miss their bound.

    A group holds about ``group_rows`` pieces whatever their lengths or sources
    (rows are dealt by a hash of their own number), so no task grows with the
    input and equal rows do not meet. Also returned: ``round``, the exchange round
    in which the sequence became final, and ``group_sequences`` and ``group_bound``: into
    how many sequences its group was packed then and the fewest that any packing of that
    group needs. Exchange goes on while it gives up fewer pieces than before; the round
    after that is the last. A piece beyond the capacity raises. An empty table gives an
    empty result.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rest = cut(pieces.select(*names, F.monotonically_increasing_id().alias("u")))
    found = rest.agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).first()
    n = found["n"]
    if n and found["longest"] > capacity:
        raise ValueError(f"a piece of {found['longest']} tokens for sequences of {capacity}")
    schema = f"{PIECES}, u long, g long, bin long, offset long, open boolean, group_sequences long, group_bound long"
    said = ["group_sequences", "group_bound"]
    out = rest.select(*names, F.lit(0).alias("round"), *(F.lit(0).cast("long").alias(c) for c in ("sequence_id", "offset", *said))).limit(0)
    k, before = 0, None
    while n:
        k += 1
        groups = max(1, -(-n // group_rows))
        last = groups == 1 or (before is not None and n > 0.9 * before)
        dealt = rest.withColumn("g", F.pmod(F.xxhash64("u", F.lit(k)), F.lit(groups)))
        packed = cut(dealt.groupBy("g").applyInArrow(_packer(capacity, last), schema))
        # 8 bits of round, 28 of group, 27 of the sequence's number in its group
        number = F.lit(k % 256 << 55) + F.col("g") * (1 << 27) + F.col("bin")
        final = packed.where(~F.col("open"))
        out = out.unionByName(final.select(*names, F.lit(k).alias("round"), number.alias("sequence_id"), "offset", *said))
        rest = packed.where("open").select(*names, "u")
        before, n = n, rest.count()
    return out
