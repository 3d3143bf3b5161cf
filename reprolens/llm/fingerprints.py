"""Merkle fingerprints of documents.

A text is cut, byte by byte and without loss, into sections (at blank lines),
paragraphs (at line ends) and pieces (at white space chosen by the bytes before it,
so that an edit moves only the cuts beside it). Pieces are hashed; each paragraph,
section and the root hash the digests below them. Equal roots mean equal texts, and
descending into differing branches locates an edit.

A fingerprint is ``root:`` and the pieces' short digests, paragraphs separated by
``,`` and sections by ``/``. Its likeness to another is the share of pieces in
common, counted with repetition. Both trees are descended together: equal roots end it,
equal sections are set aside whole, then equal paragraphs of the rest, and only the
pieces of paragraphs that differ are compared.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import blocks, text_or_empty

#: A cut falls after about one in so many words; a piece of over MOST bytes is cut
#: again every STEP bytes from its start.
WORDS_PER_PIECE = 4
MOST, STEP = 64, 32
_SHORT = 4


def _digest(data) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _cuts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of pieces, paragraphs and sections of a text's bytes."""
    n = len(raw)
    window = np.zeros(n, np.uint32)
    for back, factor in ((1, 0x9E3779B1), (2, 0x85EBCA6B), (3, 0xC2B2AE35), (4, 0x27D4EB2F)):
        window[back:] += raw[:-back].astype(np.uint32) * np.uint32(factor) if n > back else np.uint32(0)
    window ^= window >> np.uint32(15)
    window *= np.uint32(0x2C1B3C6D)
    window ^= window >> np.uint32(13)
    line = raw == 10
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    cut = line | (blank & (window % WORDS_PER_PIECE == 0))
    cut[-1] = True
    ends = np.flatnonzero(cut) + 1
    starts = np.concatenate([[0], ends[:-1]])
    for i in np.flatnonzero(ends - starts > MOST).tolist():
        cut[starts[i] + STEP - 1 : ends[i] : STEP] = True
    # a section ends with the last line end of a run of them
    section = line.copy()
    section[:-1] &= ~line[1:]
    section[1:] &= line[:-1]
    section[0] = False
    section[-1] = line[-1] = True
    return np.flatnonzero(cut) + 1, np.flatnonzero(line) + 1, np.flatnonzero(section) + 1


class Tree:
    """The tree of one text: ``root``, ``sections`` (digest, paragraphs), where a
    paragraph is (digest, first byte, bytes, piece digests)."""

    def __init__(self, text: str):
        data = text.encode("utf-8", "surrogatepass")
        self.sections: list[tuple[bytes, list]] = []
        if data:
            view = memoryview(data)
            ends, lines, parts = _cuts(np.frombuffer(data, np.uint8))
            line_at, part_at = set(lines.tolist()), set(parts.tolist())
            start = first = 0
            pieces: list[bytes] = []
            paragraphs: list = []
            for end in ends.tolist():
                pieces.append(_digest(view[start:end]))
                start = end
                if end in line_at:
                    paragraphs.append((_digest(b"p" + b"".join(pieces)), first, end - first, pieces))
                    first, pieces = end, []
                    if end in part_at:
                        self.sections.append((_digest(b"s" + b"".join(p[0] for p in paragraphs)), paragraphs))
                        paragraphs = []
        self.root = _digest(b"r" + b"".join(s[0] for s in self.sections)).hex()

    def text(self) -> str:
        """The fingerprint."""
        return self.root + ":" + "/".join(",".join("".join(d[:_SHORT].hex() for d in p[3]) for p in ps) for _, ps in self.sections)

    def branches(self) -> tuple[str, list[tuple[bytes, list[tuple[bytes, list[bytes]]]]]]:
        """The root, and per section its digest and per paragraph the digest and pieces."""
        return self.root, [(d, [(p[0], [x[:_SHORT] for x in p[3]]) for p in ps]) for d, ps in self.sections]


def branches_of(fingerprint: str) -> tuple[str, list]:
    """The same from a fingerprint: what stands for a branch is all that is below it."""
    root, _, body = fingerprint.partition(":")
    step = 2 * _SHORT
    parts = body.split("/") if body else []
    return root, [(s, [(p, [p[i : i + step] for i in range(0, len(p), step)]) for p in s.split(",")]) for s in parts]


def _apart(a: list, b: list) -> tuple[list[int], list[int]]:
    """Places of the branches of either side that the other lacks, equal ones set off against each other."""
    left = Counter(d for d, _ in b)
    mine = []
    for i, (d, _) in enumerate(a):
        if left[d]:
            left[d] -= 1
        else:
            mine.append(i)
    others = []
    for i in reversed(range(len(b))):
        if left[b[i][0]]:
            left[b[i][0]] -= 1
            others.append(i)
    return mine, others


def _differing(a: list, b: list) -> tuple[list, list]:
    """(section, paragraph) places of the paragraphs of both sides in sections that differ
    and that the other side's such sections lack."""
    mine, others = _apart(a, b)
    flat = lambda side, at: [((i, j), p) for i in at for j, p in enumerate(side[i][1])]
    x, y = flat(a, mine), flat(b, others)
    mine, others = _apart([p for _, p in x], [p for _, p in y])
    return [x[i] for i in mine], [y[i] for i in others]


def likeness_of(a: tuple[str, list], b: tuple[str, list]) -> float:
    """Likeness of two trees' ``branches``; 1 for equal roots."""
    if a[0] == b[0]:
        return 1.0
    total = sum(len(p) for side in (a[1], b[1]) for _, ps in side for _, p in ps)
    x, y = (Counter(piece for _, (_, pieces) in side for piece in pieces) for side in _differing(a[1], b[1]))
    apart = sum(x.values()) + sum(y.values())
    # what was set aside is as much on either side
    same = (total - apart) // 2 + sum((x & y).values())
    return same / (total - same) if total else 1.0


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1; 1 for equal roots, and for two empty texts."""
    return likeness_of(branches_of(a), branches_of(b))


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) places of fingerprint ``a`` where it differs from ``b``, found by
    descending into sections that differ; none if the roots are equal."""
    x, y = branches_of(a), branches_of(b)
    return [] if x[0] == y[0] else sorted(at for at, _ in _differing(x[1], y[1])[0])


NODES = "array<struct<digest:string,paragraphs:array<struct<digest:string,start:long,length:long>>>>"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``root``, ``fingerprint`` and ``sections`` with their paragraphs
    (digest, first byte, bytes). Null text counts as empty: a root without sections.
    Each row is taken by itself, so repeated rows give equal results. An empty table
    gives an empty result."""
    kind = dict(docs.dtypes)[id_col]

    def of(batches):
        for b in blocks(batches):
            out = {"id": b.column(0), "root": [], "fingerprint": [], "sections": []}
            for t in b.column(1).to_pylist():
                tree = Tree(t)
                out["root"].append(tree.root)
                out["fingerprint"].append(tree.text())
                out["sections"].append(
                    [{"digest": d.hex(), "paragraphs": [{"digest": p[0].hex(), "start": p[1], "length": p[2]} for p in ps]} for d, ps in tree.sections]
                )
            node = pa.list_(pa.struct([("digest", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [out["id"], pa.array(out["root"]), pa.array(out["fingerprint"]), pa.array(out["sections"], pa.list_(pa.struct([("digest", pa.string()), ("paragraphs", node)])))],
                names=list(out),
            )

    made = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t")).mapInArrow(of, f"id {kind}, root string, fingerprint string, sections {NODES}")
    return made.withColumnRenamed("id", id_col)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edits(batches):
    """Rows (b, extra, key, doc_id, t) of whole ranges in order, each range closed by
    a row with ``extra`` 1, the document after its last one."""
    held = None  # range, id, text and tree of the row before

    def closed(row, text, tree):
        _, doc_id, own, own_tree = row
        n = len(own)
        edited = own[: n - n // 4] + text[: n // 4]
        new = Tree(edited)
        mine = own_tree.branches()
        return (
            doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own_tree.text(), new.text(),
            likeness_of(mine, new.branches()),
            likeness_of(mine, tree.branches()),
        )

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    for b in blocks(batches):
        out = []
        for r, extra, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            if extra and held is None:
                continue  # rows that repeat the closing identifier
            tree = Tree(text)
            if held is not None:
                out.append(closed(held, text, tree))
            held = None if extra else (r, doc_id, text, tree)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def edited_neighbours(docs: DataFrame, ranges: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit: the last quarter of its code points
    replaced by the first as many of the next document's, by ascending id (after the
    last the first; a single document follows itself).

    Texts are shuffled once, into ranges of the identifier found from its quantiles;
    the first document of each range also closes the one before. Null text counts as
    empty; null identifiers come first; rows that repeat an identifier follow each
    other by text. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("key"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("t")
    )
    cuts = rows.stat.approxQuantile("key", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    cuts = sorted({int(c) for c in cuts})
    steps = [1 << i for i in reversed(range(max(len(cuts), 1).bit_length()))]

    def placed(df: DataFrame) -> DataFrame:
        # binary search among the cuts: how many are below the key
        df = df.withColumn("b", F.lit(0))
        if cuts:
            at = F.array(*(F.lit(c) for c in cuts))
            for s in steps:
                df = df.withColumn("b", F.col("b") + F.when(F.get(at, F.col("b") + s - 1) < F.col("key"), s).otherwise(0))
        return df

    firsts = sorted((r["b"], r["key"]) for r in placed(rows.select("key")).groupBy("b").agg(F.min("key").alias("key")).collect())
    if not firsts:
        return spark.createDataFrame([], RESULT)
    before = {b: firsts[i - 1][0] for i, (b, _) in enumerate(firsts)}
    size = len(cuts) + 1
    head = F.array(*(F.lit(dict(firsts).get(b)).cast("long") for b in range(size)))
    prior = F.array(*(F.lit(before.get(b)).cast("int") for b in range(size)))
    own = F.struct(F.col("b"), F.lit(0).alias("extra"))
    closing = F.struct(F.get(prior, F.col("b")).alias("b"), F.lit(1).alias("extra"))
    to = F.when(F.col("key") == F.get(head, F.col("b")), F.array(own, closing)).otherwise(F.array(own))
    dealt = placed(rows).select(F.explode(to).alias("to"), "key", "doc_id", "t").select("to.b", "to.extra", "key", "doc_id", "t")
    ordered = dealt.repartitionById(size, F.col("b")).sortWithinPartitions("b", "extra", "key", "t")
    return ordered.mapInArrow(_edits, RESULT)
