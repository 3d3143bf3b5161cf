"""N-gram Jaccard join by prefix filtering, and the components of its links.

A document's set holds 64-bit hashes of its distinct 5-word shingles. Sets are put
in one global order, rare shingles first: those known to be frequent (counted over
all documents) last, by count; the others by hash. Two sets of similarity 0.8 then
share a shingle among the first n - ceil(0.8 n) + 1 of each, so documents meet on
these prefix shingles only. Documents that meet pass a length and a positional
filter, the distinct pairs a bound from bucket counts, and the rest a suffix
filter and the comparison of their whole sets.

Equal sets are one class, joined once through its smallest document. Prefix shingles
that exactly the same classes have are one meeting place: only the first of them in
the global order is kept, where the positional filter is at its sharpest.

``jaccard_components`` first compares each document at a meeting place with the least
one there; only documents which that leaves in different components are then compared
with each other, so a group of copies costs in proportion to its size and no link
between different components is missed. ``jaccard_pairs`` compares all that meet and
returns every link between different sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, Words, blocks, bytes_hash, least_count, mix64, release, text_or_empty
from .graph import components, join_by_size

#: Most shingles that are known as frequent by count (a broadcast of 2 MB at most).
HEAVY = 1 << 17
#: A task reports the shingles that so many of a chunk of its documents share.
HEAVY_LOCAL = 2
CHUNK = 1_000_000
#: Sub-buckets of a prefix shingle that over 1/2000 of all documents have.
SALTS = 64
#: Up to so many identifiers (8 MB) are broadcast to find their rows.
BROADCAST_IDS = 1_000_000


def shingle_sets(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; none for a text without words."""
    w = Words(texts)
    h = bytes_hash(w.vocab)[w.codes] if len(w.vocab) else np.zeros(0, np.uint64)
    rolled = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    if len(rolled):
        rolled = mix64(h[: len(rolled)] + np.uint64(k))
        for q in range(1, k):
            rolled = mix64(rolled * np.uint64(3) + h[q : q + len(rolled)])
    out = []
    for a, b in zip(w.starts[:-1].tolist(), w.starts[1:].tolist(), strict=True):
        if b - a >= k:
            own = np.sort(rolled[a : b - k + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:  # fewer words: the whole sequence, told apart by its length
            one = np.array([b - a], np.uint64)
            for x in h[a:b]:
                one = mix64(one * np.uint64(3) + x)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def least_overlap(n: np.ndarray | int, share: int = 80):
    """Fewest common shingles of a set of n with any set at or above the similarity."""
    return -(-share * n // 100)


def signature(s: np.ndarray) -> bytes:
    """Counts of a set's elements by their top bits, two to four elements to a bucket."""
    bits = max(0, len(s).bit_length() - 2)
    if not bits:
        return bytes([min(len(s), 255)])
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def signature_bound(x: np.ndarray, y: np.ndarray) -> int:
    """At most so many common elements of the sets with these bucket counts."""
    if max(x.max(initial=0), y.max(initial=0)) == 255:
        return 1 << 62
    x, y = x.astype(np.int64), y.astype(np.int64)
    if len(x) > len(y):
        x = x.reshape(len(y), -1).sum(1)
    elif len(y) > len(x):
        y = y.reshape(len(x), -1).sum(1)
    return int(np.minimum(x, y).sum())


def _summaries(docs: DataFrame, k: int) -> DataFrame:
    """Per document ``doc_id, n, k1, k2`` (a 128-bit hash of its set) and ``sig`` (bucket
    counts), and rows with a null ``n`` that count locally frequent shingles
    (``k1`` the shingle, ``k2`` times)."""
    import xxhash

    names = ["doc_id", "n", "k1", "k2", "sig"]

    def of(batches):
        held, size = [], 0

        def frequent():
            nonlocal held, size
            if not held:
                return
            flat = np.sort(np.concatenate(held))
            held, size = [], 0
            at = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1], [True]]))
            times = np.diff(at)
            often = times >= HEAVY_LOCAL
            u, c = flat[at[:-1][often]], times[often]
            if len(u):
                none = pa.nulls(len(u), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(u.view(np.int64)), pa.array(c.astype(np.int64)), pa.nulls(len(u), pa.binary())], names=names)

        for b in blocks(batches):
            sets = shingle_sets(b.column(1), k)
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([signature(s) for s in sets], pa.binary())], names=names)
            held += sets
            size += int(n.sum())
            if size >= CHUNK:
                yield from frequent()
        yield from frequent()
        release()

    return docs.mapInArrow(of, "doc_id long, n long, k1 long, k2 long, sig binary")


def _prefixes(docs: DataFrame, heavy: np.ndarray, hot: np.ndarray, k: int, share: int) -> DataFrame:
    """``doc_id, n, h, pos, salt`` for each prefix shingle of each document. ``heavy``
    lists frequent shingles, rarest first; those in ``hot`` are dealt over sub-buckets."""
    order = np.argsort(heavy)
    known, rank = heavy[order], np.arange(len(heavy))[order]
    hot = np.sort(hot)

    def of(batches):
        for b in blocks(batches):
            sets = shingle_sets(b.column(1), k)
            ids = np.array([0 if d is None else d for d in b.column(0).to_pylist()], np.int64)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            n[np.asarray(b.column(0).is_null())] = 0
            flat = np.concatenate([s[:m] for s, m in zip(sets, n.tolist(), strict=True)]) if len(sets) else np.zeros(0, np.uint64)
            if not len(flat):
                continue
            owner = np.repeat(np.arange(len(n)), n)
            if len(known):
                # each set is in the order of its hashes: known ones go to its end, by rank
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                often = np.flatnonzero(known[at] == flat)
                late = np.zeros(len(flat), np.int64)
                late[often] = 1 + rank[at[often]]
                moved = np.lexsort((late, owner))
                flat = flat[moved]
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            kept = np.flatnonzero(pos < (n - least_overlap(n, share) + 1)[owner])
            h, owner = flat[kept], owner[kept]
            salt = np.zeros(len(h), np.int32)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                salt = np.where(hot[at] == h, 1 + ids[owner] % SALTS, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[owner]), pa.array(n[owner].astype(np.int32)), pa.array(h.view(np.int64)), pa.array(pos[kept].astype(np.int32)), pa.array(salt)],
                names=["doc_id", "n", "h", "pos", "salt"],
            )
        release()

    return docs.mapInArrow(of, "doc_id long, n int, h long, pos int, salt int")


def _may_link(na: Column, pa_: Column, nb: Column, pb: Column, share: int) -> Column:
    """Length filter, and the positional filter as if this were the first shingle in
    common: for a pair that links it is at the one that really is."""
    both = na.cast("long") + nb.cast("long")
    overlap = 1 + F.least(na - pa_ - 1, nb - pb - 1)
    return (100 * F.least(na, nb) >= share * F.greatest(na, nb)) & (overlap * (100 + share) >= share * both)


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """At most so many common elements of two sorted sets: halved at pivots of x,
    each part has no more of them than its smaller side."""
    if depth == 0 or not len(x) or not len(y):
        return min(len(x), len(y))
    mid = len(x) // 2
    at = int(np.searchsorted(y, x[mid]))
    return suffix_bound(x[:mid], y[:at], depth - 1) + suffix_bound(x[mid:], y[at:], depth - 1)


class _Join:
    """The tables of one join: every document with its class (``mapped``), the meeting
    places (``inside``), and the verification of pairs of class representatives."""

    def __init__(self, docs: DataFrame, k: int, share: int, id_col: str, text_col: str):
        self.k, self.share, self.id_col = k, share, id_col
        self.own = own = Scratch(docs.sparkSession, "jaccard")
        self.rows = rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("t"))
        self.seen = seen = own.keep("seen", _summaries(rows, k))
        each = seen.where("n is not null").drop("sig")
        self.total = each.count()
        classes = each.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members"))
        self.alone = own.keep("alone", each.where("n = 0 or doc_id is null").select("doc_id", "n"))
        self.mapped = own.keep("mapped", join_by_size(each.where("n > 0 and doc_id is not null"), own.keep("classes", classes), ["k1", "k2", "n"], "members", self.total).select("doc_id", "n", "rep", "members"))
        own.drop("classes")
        counted = own.keep("counted", seen.where("n is null").groupBy("k1").agg(F.sum("k2").alias("times")))
        # at most HEAVY rows, found without a sort of all on the driver
        top = counted.where(F.col("times") >= least_count(counted, "times", HEAVY)).toArrow()
        order = np.lexsort((top["k1"].to_numpy(), top["times"].to_numpy()))
        heavy, often = top["k1"].to_numpy()[order].view(np.uint64), top["times"].to_numpy()[order]
        own.drop("counted")
        hot = heavy[often > max(self.total // 2000, 64)]

        # one document of each class: few others are left out before their prefixes are made
        copies = own.keep("copies", self.mapped.where("doc_id <> rep").select("doc_id").distinct())
        few = copies.count() <= BROADCAST_IDS
        prefix = _prefixes(rows.join(F.broadcast(copies), "doc_id", "left_anti") if few else rows, heavy, hot, k, share)
        # prefix shingles that more than one document has
        met = prefix.withColumn("same", F.expr("count(1) over (partition by h, salt)")).where("same > 1 or salt > 0").drop("same", "salt")
        met = own.keep("met", met if few else met.join(copies, "doc_id", "left_anti"))
        sizes = met.groupBy("h").agg(
            F.count(F.lit(1)).alias("size"),
            F.min(F.struct("doc_id", "n", "pos")).alias("first"),
            F.sum(F.hash("doc_id").cast("long")).alias("x1"),
            F.bit_xor(F.xxhash64("doc_id")).alias("x2"),
        )
        # the same documents meet at each of these: the first in the global order stands for all
        places = sizes.where("size > 1").groupBy("size", "x1", "x2").agg(F.min(F.struct("first.pos", "h", "first")).alias("at"))
        places = own.keep("places", places.select("at.h", "size", "at.first"))
        self.inside = own.keep("inside", join_by_size(met, places, ["h"], "size", met.count()))
        own.drop("met", "places", "copies")
        self.entries = self.inside.count()

    def _of_pairs(self, table: DataFrame, pairs: DataFrame) -> DataFrame:
        """The rows of ``table`` for the documents of some pairs (a, b)."""
        ids = self.own.keep("ids", pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        # few identifiers go to the rows; many and the rows are shuffled
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        return table.join(ids, "doc_id", "left_semi")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that reach the similarity, with ``same``, the common shingles,
        and ``na`` and ``nb``: bounded by bucket counts and by the suffix filter, then each
        verified once on the whole sets."""
        k, share, own = self.k, self.share, self.own

        def whole_sets(batches):
            for b in blocks(batches):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingle_sets(b.column(1), k)], pa.binary())], names=["doc_id", "v"])
            release()

        def bounded(batches):
            for b in batches:
                total = b.column(2).to_numpy() + b.column(3).to_numpy()
                top = np.fromiter(
                    (signature_bound(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) for x, y in zip(b.column(4), b.column(5), strict=True)), np.float64, b.num_rows
                )
                yield b.select(["a", "b", "na", "nb"]).filter(pa.array(top * (100 + share) >= share * total))

        def exact(batches):
            for b in batches:
                left, right = b.column(4), b.column(5)
                same = np.zeros(b.num_rows, np.int64)
                keep = np.zeros(b.num_rows, bool)
                for i in range(b.num_rows):
                    x, y = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                    total = len(x) + len(y)
                    if suffix_bound(x, y) * (100 + share) < share * total:
                        continue
                    same[i] = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = 100 * same[i] >= share * (total - same[i])
                yield pa.RecordBatch.from_arrays([*b.select(["a", "b", "na", "nb"]).columns, pa.array(same)], names=["a", "b", "na", "nb", "same"]).filter(pa.array(keep))
            release()

        def beside(pairs: DataFrame, values: DataFrame) -> DataFrame:
            at = lambda c: values.select(F.col("doc_id").alias(c), F.col("v").alias(f"v{c}"))
            return pairs.join(at("b"), "b").join(at("a"), "a").select("a", "b", "na", "nb", "va", "vb")

        kept = "a long, b long, na long, nb long"
        sized = self._of_pairs(self.seen.where("n is not null").select("doc_id", F.struct("n", "sig").alias("v")), pairs)
        rough = beside(pairs.withColumns({"na": F.lit(0), "nb": F.lit(0)}), sized)
        rough = rough.select("a", "b", F.col("va.n").alias("na"), F.col("vb.n").alias("nb"), F.col("va.sig").alias("va"), F.col("vb.sig").alias("vb"))
        likely = own.keep("likely", rough.mapInArrow(bounded, kept))
        sets = self._of_pairs(self.rows, likely).mapInArrow(whole_sets, "doc_id long, v binary")
        # shuffled whatever the sizes: a task that made sets and compared them would take two Python workers
        found = beside(likely, sets.hint("merge")).mapInArrow(exact, f"{kept}, same long").dropDuplicates(["a", "b"])
        found = own.keep(name, found)
        own.drop("likely", "ids")
        return found


def jaccard_components(docs: DataFrame, k: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, ``n_shingles`` and ``component_id``, the smallest id that links reach.

    Two documents link when 100 * intersection >= share * union of their sets.
    Null or empty texts have no shingles and link with nothing. Rows that repeat an
    identifier are resolved each by its own text; a null identifier keeps a null
    component. An empty table gives an empty result. Other columns are ignored.
    """
    j = _Join(docs, k, share, id_col, text_col)
    own, inside = j.own, j.inside
    star = (
        inside.where(F.col("doc_id") != F.col("first.doc_id"))
        .where(_may_link(F.col("n"), F.col("pos"), F.col("first.n"), F.col("first.pos"), share))
        .select(F.col("first.doc_id").alias("a"), F.col("doc_id").alias("b"))
        .distinct()
    )
    tried = own.keep("star", star)
    links = j.verified(tried, "links0").select("a", "b")
    label = components(links)

    def place(label: DataFrame) -> DataFrame:
        """Meeting places whose documents are in more than one component."""
        out = inside.select("h", "doc_id", "n", "pos").join(label.toDF("doc_id", "label"), "doc_id", "left")
        out = own.keep("labelled", out.withColumn("label", F.coalesce("label", "doc_id")))
        apart = out.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi").select("h", "size")
        return own.keep("placed", join_by_size(out, apart, ["h"], "size", j.entries).drop("size"))

    # what the stars left apart is first compared with some member of the largest
    # component at each shingle, so that stragglers of a large group join it
    placed = place(label)
    tally = placed.groupBy("h", "label").agg(F.count(F.lit(1)).alias("c"), F.min_by(F.struct("doc_id", "n", "pos"), F.xxhash64("doc_id", "h")).alias("some"))
    largest = tally.groupBy("h").agg(F.max_by(F.struct("label", "some"), F.struct("c", "label")).alias("big"), F.sum("c").alias("size"))
    close = (
        join_by_size(placed, largest, ["h"], "size", j.entries)
        .where(F.col("label") != F.col("big.label"))
        .where(_may_link(F.col("n"), F.col("pos"), F.col("big.some.n"), F.col("big.some.pos"), share))
        .select(F.least("doc_id", "big.some.doc_id").alias("a"), F.greatest("doc_id", "big.some.doc_id").alias("b"))
        .distinct()
        .join(tried, ["a", "b"], "left_anti")
    )
    close = own.keep("close", close)
    if close.limit(1).count():
        found = j.verified(close, "links1").select("a", "b")
        if found.limit(1).count():
            links = links.unionByName(found)
            label = components(links)
            placed = place(label)
        tried = tried.unionByName(close)

    # then all that are still in different components
    cross = _all_pairs(placed, j.entries, share, F.col("a.label") != F.col("b.label"))
    cross = own.keep("cross", cross.join(tried, ["a", "b"], "left_anti"))
    if cross.limit(1).count():
        more = j.verified(cross, "links2").select("a", "b")
        if more.limit(1).count():
            label = components(links.unionByName(more))
    own.drop("seen", "star", "close", "cross", "labelled", "placed", "inside", "links0", "links1", "links2")

    # every row by its class, whose label is the smallest id of its component
    linked = join_by_size(j.mapped, _sized(label.toDF("rep", "label"), j.mapped), ["rep"], "size", j.total)
    one = j.mapped.join(label.toDF("rep", "label"), "rep", "left_anti").withColumn("label", F.col("rep"))
    out = linked.select("doc_id", "n", "label").unionByName(one.select("doc_id", "n", "label")).unionByName(j.alone.withColumn("label", F.col("doc_id")))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("label").alias("component_id"))


def _sized(label: DataFrame, mapped: DataFrame) -> DataFrame:
    """``label`` (rep, label) with the number of rows that each class has."""
    return label.join(mapped.groupBy("rep").agg(F.count(F.lit(1)).alias("size")), "rep")


def _all_pairs(placed: DataFrame, entries: int, share: int, where: Column | None = None) -> DataFrame:
    """Distinct pairs (a < b) of documents that meet and may link. A place with over
    1/2000 of all entries is dealt out: one side by document, the other copied to all."""
    size = placed.groupBy("h").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > max(entries // 2000, 64))
    marked = placed.join(F.broadcast(size), "h", "left")  # at most 2000 places
    a = marked.withColumn("salt", F.when(F.col("size").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))).drop("size").alias("a")
    deal = F.when(F.col("size").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    b = marked.withColumn("salt", F.explode(deal)).drop("size").alias("b")
    met = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.doc_id") < F.col("b.doc_id")))
    met = met.where(_may_link(F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.pos"), share))
    met = met.where(where) if where is not None else met
    return met.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct()


def jaccard_pairs(docs: DataFrame, k: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The join itself. First, each link between different sets once: ``a`` < ``b`` (the
    smallest identifiers of the two classes), ``same`` (common shingles) and ``jaccard``.
    Second, the membership: every input row's id, ``n_shingles`` and ``class_id``, the
    smallest id with the same set; copies are not expanded into pairs.

    Every pair that meets and may link is verified, so the work is at least the number
    of links, which in a group of texts that are all near copies of each other grows with
    the square of its different sets: ask for components where these alone are needed.
    Null and empty texts are in the membership with class null and in no link. An empty
    table gives empty results.
    """
    j = _Join(docs, k, share, id_col, text_col)
    pairs = j.own.keep("pairs", _all_pairs(j.inside.select("h", "doc_id", "n", "pos"), j.entries, share))
    links = j.verified(pairs, "links")
    j.own.drop("seen", "pairs", "inside")
    links = links.select("a", "b", "same", (F.col("same") / (F.col("na") + F.col("nb") - F.col("same"))).alias("jaccard"))
    rows = j.mapped.select("doc_id", "n", F.col("rep").alias("class_id")).unionByName(j.alone.withColumn("class_id", F.lit(None).cast("long")))
    return links, rows.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "class_id")


def one_of_each(docs: DataFrame, k: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those whose component has a smaller identifier; columns unchanged.

    Null and empty texts stay, and rows with a null identifier. An empty table gives an
    empty result.
    """
    found = jaccard_components(docs, k, share, id_col, text_col)
    gone = found.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("_gone")).distinct()
    gone = Scratch(docs.sparkSession, "jaccard").keep("gone", gone)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, docs[id_col].cast("long") == F.col("_gone"), "left_anti")
