"""Document quality by regularised quadratic discriminant analysis.

Statistics of a text are computed with Arrow kernels and transformed to be near
normal (logs, logits). Class means and covariances come from sums of products
over every labelled training row (one small row per partition and class, added by
Spark). Each class covariance is shrunk towards the pooled one and towards its
diagonal; its Cholesky factor is kept with the model. A score is the logistic of
the difference of the classes' log densities (Mahalanobis distances by solves
against the factors) plus the log of their prior odds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Words, blocks, cut, release, small_batches, text_or_empty

#: Up to so many labels (24 MB) are broadcast to find their documents.
BROADCAST_LABELS = 1_000_000

NAMES = (
    "log_chars", "log_words", "word_length", "word_length_sd", "letters", "upper", "digits", "spaces", "symbols",
    "punctuation", "bars", "line_repeats", "word_variety", "top_word", "long_words", "line_length", "symbol_words",
)


def _share(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Logit of a smoothed share."""
    p = (count + 0.5) / (of + 1.0)
    return np.log(p) - np.log1p(-np.minimum(p, 1 - 1e-9))


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text, each of them finite (nulls are empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    chars = np.asarray(pc.utf8_length(texts), dtype=float)
    buffer = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = buffer[ends[0] : ends[-1]]
    at = ends - ends[0]

    # ASCII classes counted on the bytes; a UTF-8 continuation byte is no character
    kind = np.zeros(256, np.uint8)
    kind[65:91], kind[97:123], kind[48:58] = 1, 2, 3
    kind[[9, 10, 11, 12, 13, 32]] = 4
    kind[[ord(c) for c in ".,;:'\"()-?"]] = 5
    kind[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~!"]] = 6
    kind[ord("|")] = 7
    kind[192:] = 8  # first bytes of other characters

    def per(mask: np.ndarray) -> np.ndarray:
        # 32-bit sums are enough within a block
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return (total[at[1:]] - total[at[:-1]]).astype(float)

    kinds = kind[raw]
    n = {k: per(kinds == k) for k in range(1, 9)}
    letters = n[1] + n[2] + n[8]

    w = Words(texts, lower=False)
    sizes = np.asarray(pc.binary_length(w.vocab), dtype=float)[w.codes]
    # a word that ends in a symbol other than common punctuation
    last = np.asarray(pc.match_substring_regex(w.vocab, r"[#$%&*+/<=>@\\^_`{}~!|]$").to_numpy(zero_copy_only=False), float)[w.codes]
    words = w.counts.astype(float)
    many = np.maximum(words, 1)

    def by_word(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(values)])
        return total[w.starts[1:]] - total[w.starts[:-1]]

    mean = by_word(sizes) / many
    spread = np.sqrt(np.maximum(by_word(sizes**2) / many - mean**2, 0))
    key = np.sort(w.owner() * max(len(w.vocab), 1) + w.codes)
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    owner = key[new] // max(len(w.vocab), 1)
    times = np.diff(np.concatenate([new, [len(key)]]))
    distinct = np.bincount(owner, minlength=len(w)).astype(float)
    top = np.zeros(len(w))
    np.maximum.at(top, owner, times)

    lists = pc.split_pattern(texts, "\n")
    bounds = np.asarray(lists.offsets).astype(np.int64)
    lines = lists.flatten().dictionary_encode()
    codes = np.asarray(lines.indices).astype(np.int64)
    held = np.diff(bounds)
    line_key = np.sort(np.repeat(np.arange(len(held)), held) * max(len(lines.dictionary), 1) + codes)
    fresh = np.concatenate([[True], line_key[1:] != line_key[:-1]]) if len(line_key) else np.zeros(0, bool)
    kinds_of_line = np.bincount(line_key[fresh] // max(len(lines.dictionary), 1), minlength=len(held)).astype(float)

    return np.column_stack([
        np.log1p(chars), np.log1p(words), np.log1p(mean), np.log1p(spread),
        _share(letters, chars), _share(n[1], letters), _share(n[3], chars), _share(n[4], chars), _share(n[6], chars),
        _share(n[5], chars), _share(n[7], chars), _share(held - kinds_of_line, held.astype(float)),
        np.log1p(distinct) - np.log1p(words), _share(top, words), _share(by_word(sizes > 14), words),
        np.log1p(chars / np.maximum(held, 1)), _share(by_word(last), words),
    ])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``x``, the statistics of each whole text, one row per input row."""

    def of(batches):
        for b in blocks(batches):
            x = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))],
                names=["id", "x"],
            )
        release()

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t")).mapInArrow(of, f"id {kind}, x array<double>")


@dataclass
class Discriminant:
    """Means, Cholesky factors and log determinants of both classes, and log prior odds."""

    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray
    log_odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        density = []
        for mean, factor, logdet in zip(self.means, self.factors, self.logdets, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            density.append(-0.5 * (z**2).sum(0) - 0.5 * logdet)
        return 1 / (1 + np.exp(-np.clip(self.log_odds + density[1] - density[0], -500, 500)))


def fit(labelled: DataFrame, shrink_pooled: float = 0.1, shrink_diagonal: float = 0.01, floor: float = 1e-3) -> Discriminant:
    """Fit on rows (``x``, or the text ``t``, and ``y`` 0 or 1), all of them; other labels
    and nulls are left out.

    Covariance of class c: (1 - a)(1 - b) S_c + a (1 - b) S_pooled + b diag(S_c) + floor I
    with a, b the two shrinkages. A class without rows takes the pooled moments; with
    no labelled rows at all every score is one half.
    """
    p = len(NAMES)
    given = "x" if "x" in labelled.columns else "t"

    def sums(batches):
        total = np.zeros((2, 1 + p + p * p))
        for b in batches if given == "x" else blocks(batches):
            y = b.column(1).to_numpy(zero_copy_only=False)
            x = np.asarray(b.column(0).flatten()).reshape(-1, p) if given == "x" else statistics(b.column(0))
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        for c in (0, 1):
            yield pa.RecordBatch.from_arrays(
                [pa.array([c], pa.int32()), pa.array([total[c].tolist()], pa.list_(pa.float64()))], names=["y", "s"]
            )
        release()

    rows = labelled.where("y in (0, 1)").select(given, F.col("y").cast("int").alias("y")).mapInArrow(sums, "y int, s array<double>")
    # two rows of one number for each entry of the moments, whatever the input's size
    with small_batches(labelled.sparkSession):
        added = rows.select("y", F.posexplode("s").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((2, 1 + p + p * p))
    for r in added:
        total[r["y"], r["i"]] = r["v"]
    n = total[:, 0]
    if not n.sum():
        return Discriminant(np.zeros((2, p)), np.stack([np.eye(p)] * 2), np.zeros(2), 0.0)
    pooled_mean = total[:, 1 : 1 + p].sum(0) / n.sum()
    means, scatter = [], []
    for c in (0, 1):
        mean = total[c, 1 : 1 + p] / n[c] if n[c] else pooled_mean
        means.append(mean)
        scatter.append(total[c, 1 + p :].reshape(p, p) - n[c] * np.outer(mean, mean))
    pooled = sum(scatter) / max(n.sum() - 2, 1)
    factors, logdets = [], []
    for c in (0, 1):
        own = scatter[c] / max(n[c] - 1, 1) if n[c] > p else pooled
        cov = (1 - shrink_diagonal) * ((1 - shrink_pooled) * own + shrink_pooled * pooled)
        cov += shrink_diagonal * np.diag(np.diag(own)) + floor * np.eye(p)
        factor = np.linalg.cholesky(cov)
        factors.append(factor)
        logdets.append(2 * np.log(np.diag(factor)).sum())
    odds = np.log((n[1] + 0.5) / (n[0] + 0.5))
    return Discriminant(np.array(means), np.array(factors), np.array(logdets), float(odds))


def score_features(x: DataFrame, model: Discriminant) -> DataFrame:
    """``x`` (id, x) with ``score``."""

    def of(batches):
        for b in batches:
            own = np.asarray(b.column(1).flatten()).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(own))], names=["id", "score"])

    return x.mapInArrow(of, f"id {dict(x.dtypes)['id']}, score double")


def _known(labels: DataFrame, folds: int, held: int, id_col: str) -> DataFrame:
    """``id, y`` of the labels to learn from; others than 0 and 1 are left out."""
    return labels.where(F.crc32(F.col(id_col).cast("string")) % folds != held).where("quality in (0, 1)").select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("y"))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Discriminant]:
    """The statistics of all documents, kept in the shared folder, and the model fitted on
    the labelled ones whose crc32(id as text) mod ``folds`` is not ``held``.

    Each labelled row counts, so rows that repeat an identifier do, and one with two labels
    counts for both. Null texts are empty ones. Without labels or documents every score
    is one half. Other columns are ignored."""
    x = cut(features(docs, id_col, text_col))
    return x, fit(x.join(_known(labels, folds, held, id_col), "id"))


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> Discriminant:
    """The model alone, as ``train`` fits it: up to ``BROADCAST_LABELS`` labels go to the
    documents, so that statistics are computed of labelled texts only."""
    y = _known(labels, folds, held, id_col)
    if y.count() > BROADCAST_LABELS:
        return train(docs, labels, folds, held, id_col, text_col)[1]
    return fit(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t")).join(F.broadcast(y), "id"))


def classify(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: id, ``held_out``, ``score`` and ``predicted``.

    Null and empty texts get the score of their (all zero) statistics. Documents
    without a label, or with a null one, are scored and not learnt from. Repeated
    rows are scored each. An empty table gives an empty result.
    """
    x, model = train(docs, labels, folds, held, id_col, text_col)
    return score_features(x, model).select(
        F.col("id").alias(id_col),
        (F.crc32(F.col("id").cast("string")) % folds == held).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: Discriminant, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents that the model does not reject, columns unchanged whatever their
    names, in one pass. Null and empty texts are judged by their (all zero) statistics;
    repeated rows each by itself. An empty table gives an empty result."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))

    def of(batches):
        for b in blocks(batches):
            keep = model.score(statistics(b.column(names.index(text_col)))) >= threshold
            yield b.filter(pa.array(keep))
        release()

    return plain.mapInArrow(of, plain.schema).toDF(*names)
