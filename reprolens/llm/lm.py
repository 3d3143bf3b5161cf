"""Language-model scores of documents by a log-bilinear model.

Tokens are words (A-Z in lower case) and one end per document. Every word has an entry
of the neural model: the ``VOCABULARY`` most frequent words and the end one of their
own, any other word the bucket that its CRC-32 names, within which it has its add-one
share of the training tokens (one unseen type included). Entries lie in classes of
``WIDTH`` by frequency. With h = sum over the two tokens before of r C_position (r: the
vector of a token's entry, C: a matrix for each position),

    P(entry) = softmax over classes (h . q_class + b_class) * softmax over the class (h . q + b)

so the probabilities of a position sum to one.

Both softmaxes are trained in numpy by noise-contrastive estimation: minibatches of
tokens against noise sampled from the unigram shares, with AdaGrad. Every task trains on
all training documents that it reads, from the same start; the weights are added up
by Spark and averaged by tokens, so training passes over the whole corpus wherever it
lies. Scoring takes matrix products over blocks of contexts, grouped by class.

Counts of all words are a distributed table. The ``KNOWN`` most frequent ones are
broadcast with their counts; the other words of a document meet theirs in a join.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Words, blocks, cut, least_count, quiet_threads, release, text_or_empty

#: Words with an entry of their own, buckets of the other words, and entries of one class.
VOCABULARY = 6143
BUCKETS = 2048
WIDTH = 128
#: Words whose counts are broadcast (at most 16 bytes each besides their letters).
KNOWN = 1 << 18
DIMENSIONS = 16
#: Tokens before that are the context, noise samples of a group of tokens, tokens of a
#: minibatch, and passes of a task over each block of its documents.
CONTEXT = 2
NOISE = 12
BATCH = 16_384
PASSES = 1
#: Partial sums of the tasks' weights.
FAN = 16
RATE = 0.05


def held_out(doc_id: Column, folds: int = 7, held: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == held, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, c`` over texts ``t``; counted per task before the shuffle."""

    def of(batches):
        held, size = [], 0

        def flush():
            nonlocal held, size
            if held:
                table = pa.concat_tables(held).group_by("word").aggregate([("c", "sum")])
                held, size = [], 0
                for b in table.select(["word", "c_sum"]).rename_columns(["word", "c"]).cast(pa.schema([("word", pa.string()), ("c", pa.int64())])).to_batches(max_chunksize=100_000):
                    yield b

        for b in blocks(batches, 4 << 20):
            w = Words(b.column(0))
            if len(w.codes):
                c = np.bincount(w.codes, minlength=len(w.vocab))
                # the empty string between separators is no word
                own = np.flatnonzero(c)
                held.append(pa.table({"word": w.vocab.take(pa.array(own)).cast(pa.string()), "c": c[own]}))
                size += len(own)
            if size > 500_000:
                yield from flush()
        yield from flush()
        release()

    return docs.select("t").mapInArrow(of, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Weights:
    """Context vectors ``r``, position matrices ``c``, vectors and biases of the entries
    (``q``, ``b``) and of the classes (``qc``, ``bc``). Entries are ranks by frequency."""

    r: np.ndarray
    c: np.ndarray
    q: np.ndarray
    b: np.ndarray
    qc: np.ndarray
    bc: np.ndarray
    width: int = WIDTH

    NAMES = ("r", "c", "q", "b", "qc", "bc")

    @classmethod
    def start(cls, counts: np.ndarray, dimensions: int = DIMENSIONS, width: int = WIDTH, seed: int = 5) -> Weights:
        """Small random vectors and the unigram shares of ``counts`` (descending) as biases."""
        n = len(counts)
        share = (counts + 0.5) / (counts + 0.5).sum()
        classes = np.add.reduceat(share, np.arange(0, n, width))
        r = np.random.default_rng(seed)
        vectors = lambda k: r.normal(0, 0.1, (k, dimensions)).astype(np.float32)
        near = np.stack([np.eye(dimensions) / (1 + p) for p in range(CONTEXT)]).astype(np.float32)
        within = np.log(share / classes[np.arange(n) // width]).astype(np.float32)
        return cls(vectors(n), near, vectors(n), within, vectors(len(classes)), np.log(classes).astype(np.float32), width)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def filled(self, flat: np.ndarray) -> Weights:
        out, at = [], 0
        for n in self.NAMES:
            old = getattr(self, n)
            out.append(flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return Weights(*out, self.width)

    def contexts(self) -> np.ndarray:
        """The product of every entry's vector with each position's matrix."""
        return self.r[None] @ self.c

    def log10(self, before: np.ndarray, tokens: np.ndarray, block: int = 65_536) -> np.ndarray:
        """Normalised log10 probability of each token (its entry) after ``before``
        (positions, tokens), by matrix products over blocks of contexts."""
        made = self.contexts()
        out = np.empty(len(tokens))
        for at in range(0, len(tokens), block):
            t = tokens[at : at + block]
            h = made[0][before[0, at : at + block]]
            for p in range(1, CONTEXT):
                h += made[p][before[p, at : at + block]]
            kind = t // self.width
            order = np.argsort(kind.astype(np.int16), kind="stable")  # by radix
            h, t, kind = h[order], t[order], kind[order]
            value = _log_softmax_at(h @ self.qc.T + self.bc, kind)
            edges = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1], [True]]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                first = int(kind[a]) * self.width
                last = first + self.width
                value[a:b] += _log_softmax_at(h[a:b] @ self.q[first:last].T + self.b[first:last], t[a:b] - first)
            out[at + order] = value
        return out / np.log(10)


def _log_softmax_at(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    own = logits[np.arange(len(at)), at].astype(np.float64)
    total = np.exp(np.minimum(logits, 80, out=logits) if logits.max(initial=0) > 80 else logits, out=logits).sum(1)
    return own - np.log(total.astype(np.float64))


class Trainer:
    """Noise-contrastive estimation on minibatches, AdaGrad on every weight."""

    def __init__(self, weights: Weights, counts: np.ndarray, noise: int = NOISE, rate: float = RATE, seed: int = 0):
        self.w = weights
        self.noise, self.rate, self.random = noise, rate, np.random.default_rng(seed)
        share = (counts + 0.5) / (counts + 0.5).sum()
        self.width = weights.width
        starts = np.arange(0, len(counts), self.width)
        self.classes = np.add.reduceat(share, starts)
        self.within = [share[a : a + self.width] / share[a : a + self.width].sum() for a in starts]
        self.squares = {n: np.full(getattr(weights, n).shape, 1e-8, np.float32) for n in Weights.NAMES}
        self.tokens = 0

    def _contrast(self, h, q, b, share, target):
        """Gradients of one softmax for tokens with contexts h: of h, and of its vectors and biases."""
        drawn, times = np.unique(self.random.choice(len(share), self.noise, p=share), return_counts=True)
        log_noise = np.log(self.noise * share).astype(np.float32)
        odds = lambda s: 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        # probability that the token is noise, and that each noise sample is data
        own = odds((h * q[target]).sum(1) + b[target] - log_noise[target]) - 1
        others = odds(h @ q[drawn].T + (b - log_noise)[drawn]) * times.astype(np.float32)
        gh = own[:, None] * q[target] + others @ q[drawn]
        gq, gb = np.zeros_like(q), np.bincount(target, weights=own, minlength=len(b)).astype(np.float32)
        order = np.argsort(target.astype(np.int16), kind="stable")
        sorted_target = target[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_target[1:] != sorted_target[:-1]]))
        gq[sorted_target[first]] = np.add.reduceat((own[:, None] * h)[order], first, axis=0)
        gq[drawn] += others.T @ h
        gb[drawn] += others.sum(0)
        return gh, gq, gb

    def _step(self, name, gradient, at=slice(None)):
        own, square = getattr(self.w, name), self.squares[name]
        square[at] += gradient * gradient
        own[at] -= self.rate * gradient / np.sqrt(square[at])

    def batch(self, before: np.ndarray, tokens: np.ndarray) -> None:
        """One minibatch of (positions, tokens) contexts and tokens."""
        w = self.w
        kind = tokens // self.width
        order = np.argsort(kind.astype(np.int16), kind="stable")
        before, tokens, kind = before[:, order], tokens[order], kind[order]
        vectors = [w.r[before[p]] for p in range(CONTEXT)]
        h = sum(v @ c for v, c in zip(vectors, w.c, strict=True))
        n = np.float32(1 / len(tokens))
        gh, gq, gb = self._contrast(h, w.qc, w.bc, self.classes, kind)
        steps = [("qc", gq * n, slice(None)), ("bc", gb * n, slice(None))]
        edges = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1], [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            k = int(kind[a])
            at = slice(k * self.width, (k + 1) * self.width)
            own, gq, gb = self._contrast(h[a:b], w.q[at], w.b[at], self.within[k], tokens[a:b] - at.start)
            gh[a:b] += own
            steps += [("q", gq * n, at), ("b", gb * n, at)]
        gh *= n
        gr = np.zeros_like(w.r)
        for p in range(CONTEXT):
            np.add.at(gr, before[p], gh @ w.c[p].T)
        steps += [("c", np.stack([v.T @ gh for v in vectors]), slice(None)), ("r", gr, slice(None))]
        for s in steps:
            self._step(*s)
        self.tokens += len(tokens)

    def learn(self, before: np.ndarray, tokens: np.ndarray, batch: int = BATCH, passes: int = PASSES) -> None:
        for _ in range(passes):
            order = self.random.permutation(len(tokens))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                self.batch(before[:, own], tokens[own])


@dataclass
class Model:
    """Known words with their counts, most frequent first, the entries and the totals."""

    words: pa.Array
    counts: np.ndarray
    size: int  # of the words, those with an entry of their own
    place: np.ndarray  # entry (a rank by frequency) of the end, the own words and the buckets
    entry_counts: np.ndarray  # training tokens of each entry
    weights: Weights
    tokens: int  # N
    types: int  # V
    documents: int
    shares: np.ndarray  # what a bucket's words share: its tokens and types and one
    known_buckets: np.ndarray | None = None

    @property
    def buckets(self) -> int:
        return len(self.shares)

    def base(self, c):
        return np.log10((np.asarray(c) + 1.0) / (self.tokens + self.types + 1.0))

    def bucket(self, vocab: pa.Array) -> np.ndarray:
        return np.fromiter((zlib.crc32(v) for v in vocab.cast(pa.large_binary()).to_pylist()), np.int64, len(vocab)) % self.buckets

    def entries(self, vocab: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of each word among the known (-1: none), its bucket (-1: has its own
        entry) and its entry."""
        at = np.full(len(vocab), -1)
        if len(self.words) and len(vocab):
            at = pc.fill_null(pc.index_in(vocab.cast(pa.large_string()), value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        known = self.known_buckets if self.known_buckets is not None and len(self.known_buckets) else np.full(1, -1)
        bucket = np.where(at >= self.size, known[np.minimum(np.maximum(at, 0), len(known) - 1)], -1)
        rest = np.flatnonzero((at < 0) | ((at >= self.size) & (bucket < 0)))
        if len(rest):
            bucket[rest] = self.bucket(vocab.take(pa.array(rest)))
        return at, bucket, self.place[np.where(bucket >= 0, 1 + self.size + bucket, 1 + at)]

    def sequence(self, w: Words, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries of the tokens before, by position, and of all tokens, ends included,
        and where each text begins. Before a text there are ends."""
        n, end = len(w), self.place[0]
        begins = w.starts[:-1] + np.arange(n)
        tokens = np.full(len(w.codes) + n, end, np.int64)
        mask = np.ones(len(tokens), bool)
        mask[w.starts[1:] + np.arange(n)] = False
        tokens[mask] = entries[w.codes]
        since = np.arange(len(tokens)) - np.repeat(begins, w.counts + 1)
        before = np.full((CONTEXT, len(tokens)), end, np.int64)
        for p in range(CONTEXT):
            before[p, p + 1 :] = tokens[: max(len(tokens) - p - 1, 0)]
            before[p][since <= p] = end
        return before, tokens, begins


def _train(rows: DataFrame, model: Model) -> Weights:
    """Weights trained by every task on its rows (``t``), averaged by tokens."""
    start = model.weights
    size = len(start.flat())
    block = 16_384

    def of(batches):
        quiet_threads()
        trainer = None
        for b in blocks(batches, 4 << 20):
            w = Words(b.column(0))
            if not len(w):
                continue
            trainer = trainer or Trainer(start.filled(start.flat()), model.entry_counts)
            before, tokens, _ = model.sequence(w, model.entries(w.vocab)[2])
            trainer.learn(before, tokens)
        if trainer:
            own = trainer.w.flat().astype(np.float64) * trainer.tokens
            at = range(0, size, block)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(range(len(at))), pa.int32()), pa.array([trainer.tokens] * len(at), pa.int64()), pa.array([own[i : i + block].tobytes() for i in at], pa.binary())], names=["block", "n", "v"]
            )

    def added(batches):
        total: dict[int, list] = {}
        for b in batches:
            for k, n, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                own = total.setdefault(k, [0, 0.0])
                own[0] += n
                own[1] = own[1] + np.frombuffer(v.as_buffer(), np.float64)
        if total:
            keys = sorted(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int32()), pa.array([total[k][0] for k in keys], pa.int64()), pa.array([total[k][1].tobytes() for k in keys], pa.binary())], names=["block", "n", "v"]
            )

    schema = "block int, n long, v binary"
    parts = -(-size // block)
    # added up in two levels, so that no task takes a block from all tasks of the training
    made = rows.select("t").mapInArrow(of, schema).withColumn("salt", F.spark_partition_id() % FAN)
    made = made.repartition(parts * FAN, "block", "salt").select("block", "n", "v").mapInArrow(added, schema)
    summed = made.repartition(parts, "block").mapInArrow(added, schema)
    # one row for each block of the weights, whatever the input's size
    got = sorted(summed.collect(), key=lambda r: r["block"])
    return start.filled(np.concatenate([np.frombuffer(bytes(r["v"]), np.float64) / r["n"] for r in got])) if got else start


def fit(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, vocabulary: int = VOCABULARY, buckets: int = BUCKETS
) -> tuple[Model, DataFrame]:
    """The model of the documents that are not held out, and the table of word counts."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t")).where(~held_out(F.col("id"), folds, held))
    counts = cut(word_counts(rows))
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    documents = rows.select("id").count()
    top = counts.where(F.col("c") >= least_count(counts, "c", KNOWN)).toArrow()
    order = np.lexsort((np.array(top.column("word").to_pylist(), object), -top.column("c").to_numpy())) if top.num_rows else np.zeros(0, np.int64)
    words = top.column("word").combine_chunks().cast(pa.large_string()).take(pa.array(order, pa.int64()))
    known = top.column("c").to_numpy()[order].astype(np.int64)
    size = min(vocabulary, len(known))
    # tokens and types of each bucket: all words' less those of the words with their own entry
    n_in, v_in = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for r in counts.groupBy((F.crc32("word") % buckets).alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        n_in[r["k"]], v_in[r["k"]] = r["n"], r["v"]
    model = Model(words, known, size, np.zeros(0), np.zeros(0), None, int(total["n"] or 0) + documents, int(total["v"]) + (documents > 0), documents, n_in)
    model.known_buckets = model.bucket(words)
    own = model.known_buckets[:size]
    n_in -= np.bincount(own, weights=known[:size], minlength=buckets).astype(np.int64)
    v_in -= np.bincount(own, minlength=buckets)
    model.shares = n_in + v_in + 1
    entry = np.concatenate([[documents], known[:size], n_in])
    model.place = np.empty(len(entry), np.int64)
    model.place[np.argsort(-entry, kind="stable")] = np.arange(len(entry))
    model.entry_counts = np.sort(entry)[::-1].astype(np.float64)
    model.weights = Weights.start(model.entry_counts)
    model.weights = _train(rows, model)
    return model, counts


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, vocabulary: int = VOCABULARY, buckets: int = BUCKETS
) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    ``base_score`` sums log10((c + 1) / (N + V + 1)), ``score`` the model's log10
    probabilities of all tokens, the end included. Null and empty texts have the end
    alone; rows with a null identifier are not held out; repeated rows are scored each;
    an empty table gives an empty result; other columns are ignored.
    """
    return score_with(docs, *fit(docs, id_col, text_col, folds, held, vocabulary, buckets), id_col, text_col, folds, held)


def score_with(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """``score`` with a model and its word counts, as ``fit`` returns them."""
    kind = docs.schema[id_col].dataType.simpleString()

    def of(batches):
        quiet_threads()
        base_known = model.base(model.counts)
        base_end = float(model.base(model.documents))
        for b in blocks(batches, 4 << 20):
            w = Words(b.column(1))
            at, bucket, entries = model.entries(w.vocab)
            before, tokens, begins = model.sequence(w, entries)
            n = len(w)
            lm = np.add.reduceat(model.weights.log10(before, tokens), begins)
            place = at[w.codes]
            hit = place >= 0
            owner = w.owner()
            own = owner[hit]
            base = np.bincount(own, weights=base_known[place[hit]], minlength=n) + base_end
            # the share of a word in its bucket
            share = np.zeros(len(w.vocab))
            in_bucket = (at >= 0) & (bucket >= 0)
            share[in_bucket] = np.log10((model.counts[at[in_bucket]] + 1.0) / model.shares[bucket[in_bucket]])
            lm += np.bincount(owner, weights=share[w.codes], minlength=n)
            # every known word was counted in training
            known = np.bincount(own, minlength=n) + (model.documents > 0)
            row = b.column(0).to_numpy()
            ids = b.column(2)
            # a word holds no space, so these keys meet no count
            name = pa.array([f" {r}" for r in row.tolist()])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), ids, name, pa.array(w.counts + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(lm)], names=["row", "id", "word", "n", "known", "base", "score"]
            )
            key, times = np.unique(owner[~hit] * max(len(w.vocab), 1) + w.codes[~hit], return_counts=True)
            if len(key):
                size = max(len(w.vocab), 1)
                zero = pa.array(np.zeros(len(key)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(key // size)), pa.nulls(len(key), ids.type), w.vocab.take(pa.array(key % size)).cast(pa.string()), pa.array(-times), pa.nulls(len(key), pa.int64()), zero, zero],
                    names=["row", "id", "word", "n", "known", "base", "score"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), text_or_empty(text_col).alias("t"), F.col(id_col).alias("id"))
    parts = rows.mapInArrow(of, f"row long, id {kind}, word string, n long, known long, base double, score double")
    joined = parts.join(counts, "word", "left")
    rare = F.col("known").isNull()
    c = F.coalesce("c", F.lit(0))
    base = F.log10((c + 1.0) / (model.tokens + model.types + 1.0))
    shares = F.array(*(F.lit(float(s)) for s in model.shares))
    share = F.log10((c + 1.0) / F.get(shares, (F.crc32("word") % len(model.shares)).cast("int")))
    summed = joined.groupBy("row").agg(
        F.max("id").alias("id"),
        F.sum(F.when(~rare, F.col("n"))).alias("n_tokens"),
        F.sum(F.when(rare, F.when(c > 0, -F.col("n")).otherwise(0)).otherwise(F.col("known"))).alias("n_known"),
        F.sum(F.when(rare, -F.col("n") * base).otherwise(F.col("base"))).alias("base_score"),
        F.sum(F.when(rare, -F.col("n") * share).otherwise(F.col("score"))).alias("score"),
    )
    return summed.select(
        F.col("id").alias(id_col),
        held_out(F.col("id"), folds, held).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
