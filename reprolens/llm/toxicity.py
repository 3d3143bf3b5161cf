"""Toxicity by a support vector machine on a subsequence string kernel.

The kernel compares two words by their common subsequences of three characters, each
weighted by DECAY to the power of its span, so characters put between an insult's
letters lower the likeness without destroying it. Words are reduced to base letters
first, and letters set apart by spaces are joined. The machine is linear in Nyström
features on landmark words; since the kernel is a product of subsequence weights, its
function collapses into one weight for each subsequence, and a word is scored by
adding these up.

Labels are on documents. Training takes the words of labelled sentences: stems that
explain the toxic documents (a greedy cover by beginnings of words rare in clean
ones), the words with these stems, again with inserted letters, against words of
clean documents, the highest scoring of which are added and the machine trained
again. A document's two highest margins and how many of its words have a positive one
become a probability by a logistic fitted on documents.
"""

from __future__ import annotations

import heapq
import itertools
import math
import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Words, blocks, cut, text_or_empty

#: Most labelled documents of each class that training looks at, and three times the most
#: words of each kind (common, spread and hard ones) from clean documents.
MAX_DOCUMENTS = 3000
MAX_WORDS = 6000
#: Stems expected by chance among all that are tried.
CHANCE = 0.05
#: Lengths of the beginnings of words that are tried as stems.
STEMS = (4, 5, 6, 7, 8)
LANDMARKS = 400
#: Words of each class that landmarks are chosen from.
CANDIDATES = 800
DECAY = 0.7
#: Longer words are scored as overlapping windows.
WINDOW, STRIDE = 16, 8
_SIZE = 27  # letters and one class for all others
_OTHER = 26

#: Base letters of accented Latin letters, and look-alikes (fixed values).
_BASE = {
    "a": "àáâãäåāăą@4", "c": "çćč", "d": "ďđð", "e": "èéêëēęě3", "i": "ìíîïīı1", "l": "ł", "n": "ñńň", "o": "òóôõöøōő0",
    "r": "ř", "s": "śšşß$5", "t": "ťţ7", "u": "ùúûüūůű", "y": "ýÿ", "z": "źżž",
}


def _letter_table() -> np.ndarray:
    """Class of each character below 0x10000: a letter, another letter, or 255 (dropped).
    Letters beyond the Latin ones are dealt over the 26 classes by number, so that their
    words differ too."""
    table = np.full(0x10000, 255, np.uint8)
    for c in range(0x250, len(table)):
        low = chr(c).lower()
        if low[0].isalpha():
            table[c] = ord(low[0]) % 26
    for c in range(0x250):
        ch = chr(c)
        low = ch.lower()
        if "a" <= low <= "z" and len(low) == 1:
            table[c] = ord(low) - 97
        elif ch.isalpha():
            table[c] = _OTHER
    for base, chars in _BASE.items():
        for ch in chars:
            for form in {ch, ch.upper()}:
                if len(form) == 1 and ord(form) < len(table):
                    table[ord(form)] = ord(base) - 97
    return table


_TABLE = _letter_table()


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letter classes of all words in a row, and where each word begins (and the end)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    # beyond the table are rare scripts and, from 0x1F000 to 0x1FFFF, pictures
    far = np.where((points >= 0x1F000) & (points < 0x20000), 255, _OTHER)
    classes = np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], far)
    kept = np.concatenate([[0], np.cumsum(classes != 255)])
    return classes[classes != 255], kept[np.concatenate([[0], np.cumsum(sizes)])]


def windows(classes: np.ndarray, starts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, 3 to WINDOW: the word of each window and the windows' letters."""
    sizes = np.diff(starts)
    out: dict[int, list] = {}
    for n in range(3, WINDOW + 1):
        own = np.flatnonzero(sizes == n)
        if len(own):
            out[n] = [(own, classes[starts[own][:, None] + np.arange(n)])]
    for w in np.flatnonzero(sizes > WINDOW).tolist():
        last = sizes[w] - WINDOW
        at = np.unique(np.append(np.arange(0, last, STRIDE), last)) + starts[w]
        out.setdefault(WINDOW, []).append((np.full(len(at), w), classes[at[:, None] + np.arange(WINDOW)]))
    return {n: (np.concatenate([a for a, _ in v]), np.concatenate([b for _, b in v])) for n, v in out.items()}


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of a word of n letters and the weights of their spans."""
    t = np.array(list(itertools.combinations(range(n), 3)))
    return t, (DECAY ** (t[:, 2] - t[:, 0] + 1)).astype(np.float32)


_TRIPLES = {n: _triples(n) for n in range(3, WINDOW + 1)}


def _codes(x: np.ndarray) -> np.ndarray:
    t, _ = _TRIPLES[x.shape[1]]
    x = x.astype(np.int32)
    return (x[:, t[:, 0]] * _SIZE + x[:, t[:, 1]]) * _SIZE + x[:, t[:, 2]]


def own_kernel(x: np.ndarray) -> np.ndarray:
    """Kernel of each row (a word of letters) with itself, by dynamic programming."""
    rows, n = x.shape
    lam = np.float32(DECAY)
    before = np.ones((n + 1, n + 1, rows), np.float32)
    same = (x[:, :, None] == x[:, None, :]).transpose(1, 2, 0)
    for i in (1, 2):
        now = np.zeros((n + 1, n + 1, rows), np.float32)
        for a in range(i, n + 1):
            run = np.zeros(rows, np.float32)
            for b in range(i, n + 1):
                run = lam * run + lam * lam * same[a - 1, b - 1] * before[a - 1, b - 1]
                now[a, b] = lam * now[a - 1, b] + run
        before = now
    return lam * lam * (same * before[:-1, :-1]).sum((0, 1))


def explicit(words: list[str]) -> np.ndarray:
    """Normalised subsequence weights of short words (training only): one row for each."""
    out = np.zeros((len(words), _SIZE**3), np.float32)
    for n, (own, x) in windows(*letters(words)).items():
        c = _codes(x)
        # a long training word is represented by all its windows together
        np.add.at(out, (np.repeat(own, c.shape[1]), c.ravel()), np.tile(_TRIPLES[n][1], len(x)))
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return out


def kernel_with(words: list[str], landmarks: np.ndarray, block: int = 256) -> np.ndarray:
    """Normalised kernel of words with landmarks, a block of words at a time."""
    parts = [explicit(words[i : i + block]) @ landmarks.T for i in range(0, len(words), block)]
    return np.concatenate(parts) if parts else np.zeros((0, len(landmarks)), np.float32)


@dataclass
class Machine:
    """Weight of each subsequence, offset, and the logistic of a document's evidence."""

    weights: np.ndarray
    offset: float
    logistic: tuple[float, ...] = (0.0, 4.0, 0.0, 0.0, 0.0, 0.0)
    stems: tuple[str, ...] = ()
    landmarks: tuple[str, ...] = ()

    def margins(self, words: list[str]) -> np.ndarray:
        """Margin of each word; that of no likeness at all for words under three letters."""
        out = np.full(len(words), self.offset, np.float32)
        for n, (own, x) in windows(*letters(words)).items():
            weight = _TRIPLES[n][1]
            step = max(1, 4_000_000 // (len(weight) + n * n))
            for at in range(0, len(x), step):
                part = x[at : at + step]
                value = self.weights[_codes(part)] @ weight / np.sqrt(np.maximum(own_kernel(part), 1e-12)) + self.offset
                np.maximum.at(out, own[at : at + step], value)
        return out

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        """Probability that documents with this evidence (see ``document_evidence``) are toxic."""
        z = np.column_stack([np.ones(len(evidence)), evidence]) @ np.array(self.logistic)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def spelled(words: Words) -> tuple[np.ndarray, list[str]]:
    """Runs of three or more single characters between spaces, joined: text and word."""
    single = np.asarray(pc.equal(pc.utf8_length(words.vocab), 1)) if len(words.vocab) else np.zeros(0, bool)
    one = single[words.codes]
    if not one.any():
        return np.zeros(0, np.int64), []
    owner = words.owner()
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (one * (owner + 1)), [0]])))
    bounds = np.unique(edge)
    texts, found = [], []
    vocab = words.vocab
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= 3 and one[a]:
            texts.append(owner[a])
            found.append("".join(vocab[int(c)].as_py() for c in words.codes[a:b]))
    return np.array(texts, np.int64), found


def document_evidence(texts: pa.Array, machine: Machine) -> np.ndarray:
    """Per text: the highest margin of its words, the log of one plus the number of
    positive ones, where there are any, one and the log of one plus all words, and the
    second highest margin."""
    w = Words(texts)
    n = len(w)
    top, second = np.full((2, n), machine.offset, np.float32)
    hits = np.zeros(n)
    if len(w.codes):
        m, owner = machine.margins(w.vocab.to_pylist())[w.codes], w.owner()
        at, joined = spelled(w)
        if joined:
            m, owner = np.concatenate([m, machine.margins(joined)]), np.concatenate([owner, at])
        hits += np.bincount(owner, weights=m > 0, minlength=n)
        order = np.lexsort((-m, owner))
        m, owner = m[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        top[owner[first]] = m[first]
        then = first[(first + 1 < len(m)) & (owner[np.minimum(first + 1, len(m) - 1)] == owner[first])]
        second[owner[then]] = m[then + 1]
    return np.column_stack([top, np.log1p(hits), hits > 0, np.where(hits > 0, np.log1p(w.counts), 0), second]).astype(float)


def variants(word: str, n: int, seed: int) -> list[str]:
    """The word with letters inserted or doubled at n seeded places (gaps by symbols and
    spaces vanish before the kernel, so only letters need teaching)."""
    r = random.Random(f"{word}/{seed}")
    out = [word]
    for _ in range(n):
        s = list(word)
        for _ in range(r.randint(1, max(1, len(word) // 3))):
            at = r.randint(1, len(s) - 1) if len(s) > 1 else 0
            s.insert(at, r.choice([s[at - 1], "x", r.choice("abcdefghijklmnopqrstuvwxyz")]))
        out.append("".join(s))
    return out


def train_machine(positive: list[str], negative: list[str], cost: float = 10.0) -> Machine:
    """L2 support vector machine (squared hinge, Newton steps) on Nyström features."""
    if not positive or not negative:
        return Machine(np.zeros(_SIZE**3, np.float32), -1.0)
    words = positive + negative
    y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    # landmarks: of some words of either class those farthest from the ones chosen before
    some = [i for side in (np.flatnonzero(y > 0), np.flatnonzero(y < 0)) for i in side[:: max(1, len(side) // CANDIDATES)][:CANDIDATES].tolist()]
    x = explicit([words[i] for i in some])
    chosen: list[int] = []
    near = np.full(len(some), -1.0)
    for k in range(min(LANDMARKS, len(some))):
        pool = np.where(y[some] == (1 if k % 2 == 0 else -1), near, 2.0)
        i = int(np.argmin(pool))
        if pool[i] >= 0.999:
            continue
        chosen.append(i)
        near = np.maximum(near, x @ x[i])
    z = x[chosen].copy()
    del x
    values, vectors = np.linalg.eigh(z.astype(np.float64) @ z.T.astype(np.float64))
    root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
    f = np.column_stack([kernel_with(words, z) @ root, np.ones(len(words))])
    weight = np.where(y > 0, 0.5 / len(positive), 0.5 / len(negative)) * len(words) * cost
    # a word like no landmark at all is clean: it settles the offset
    f = np.vstack([f, np.append(np.zeros(f.shape[1] - 1), 1.0)])
    y, weight = np.append(y, -1.0), np.append(weight, 0.5 * len(words) * cost)
    ridge = np.eye(f.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(f.shape[1])
    for _ in range(30):
        inside = y * (f @ w) < 1
        if not inside.any():
            break
        g = f[inside] * weight[inside, None]
        new = np.linalg.solve(ridge + g.T @ f[inside], g.T @ y[inside])
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    weights = (z.T @ (root @ w[:-1])).astype(np.float32)
    return Machine(weights, float(w[-1]), landmarks=tuple(words[some[i]] for i in chosen))


def _logistic(evidence: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of a slightly penalised logistic, by damped Newton steps, with targets
    drawn in from 0 and 1."""
    x = np.column_stack([np.ones(len(evidence)), evidence])
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.zeros(x.shape[1])
    ridge = 1e-2 * np.eye(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - t) + ridge @ w)
        w = w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def _chance(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """Probability that of toxic + clean random documents so many or more are toxic."""
    n, p = toxic + clean, (n_toxic + 1) / (n_toxic + n_clean + 2)
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(toxic, n + 1))


def _cover(found: list, n_toxic: int, n_clean: int, tests: int = 1) -> list[str]:
    """Stems that explain the toxic documents: in turn the one (the longest of equals)
    in most documents that none chosen before is in, while these are 1% of the toxic
    ones, or any and the stem's own counts hardly come by chance among ``tests`` words.
    Then those which, though others stand beside them, are in one of 25 toxic documents
    and hardly in any clean one."""
    sets = {r["stem"]: (set(r["docs"]), r["clean"]) for r in found}
    left = set().union(*(d for d, _ in sets.values()))
    chosen: list[str] = []
    apart = lambda stem: not any(stem.startswith(c) or c.startswith(stem) for c in chosen)
    # keys only fall as documents are explained, so one that is still the highest is right
    keys = [(-len(d), -len(stem), tuple(-ord(ch) for ch in stem), stem) for stem, (d, _) in sets.items()]
    heapq.heapify(keys)
    while keys:
        old, *rest, stem = heapq.heappop(keys)
        docs, clean = sets[stem]
        gain = len(docs & left)
        if gain != -old:
            heapq.heappush(keys, (-gain, *rest, stem))
            continue
        if not gain:
            break
        if gain >= max(3, 0.01 * n_toxic) or (apart(stem) and tests * _chance(len(docs), clean, n_toxic, n_clean) <= CHANCE):
            chosen.append(stem)
            left -= docs
    for stem, (docs, clean) in sorted(sets.items(), key=lambda g: (-len(g[1][0]), -len(g[0]), g[0])):
        strong = len(docs) * (n_clean + 1) >= 20 * (clean + 0.3) * (n_toxic + 1)
        if strong and len(docs) >= max(5, 0.04 * n_toxic) and apart(stem):
            chosen.append(stem)
    return chosen


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Train on at most ``MAX_DOCUMENTS`` labelled documents of each class, whole texts,
    from those whose crc32(id as text) mod ``folds`` is not ``held``.

    Null and other labels than 0 and 1 are left out; an identifier with both is toxic.
    Null texts are empty ones; rows that repeat an identifier count each. Without labels of
    both classes, or documents, nothing scores as toxic. Other columns are ignored."""
    y = labels.where(F.crc32(F.col(id_col).cast("string")) % folds != held).where("toxic in (0, 1)").select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("y"))
    # an identifier with both labels is toxic
    y = y.groupBy("id").agg(F.max("y").alias("y"))
    pick = lambda c: y.where(F.col("y") == c).orderBy(F.xxhash64("id"), "id").limit(MAX_DOCUMENTS)
    # at most 2 * MAX_DOCUMENTS rows
    sample = F.broadcast(pick(1).unionByName(pick(0)))
    own = cut(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t")).join(sample, "id").select("id", "y", "t"))
    sizes = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)

    def words_of(batches):
        # a row for each word of each document, and for each beginning of one
        for b in blocks(batches):
            w = Words(b.column(2))
            if not len(w.codes):
                continue
            bare = pc.replace_substring_regex(w.vocab, r"[^\p{L}]+", "")
            n = pc.utf8_length(bare)
            parts = [(pc.and_(pc.greater_equal(n, 3), pc.less_equal(n, 40)), bare, True)]
            parts += [(pc.greater_equal(n, k), pc.utf8_slice_codeunits(bare, 0, k), False) for k in STEMS]
            for use, values, whole in parts:
                coded = values.dictionary_encode()
                to = np.asarray(coded.indices).astype(np.int64)
                used = np.asarray(use.to_numpy(zero_copy_only=False), bool)[w.codes]
                size = max(len(coded.dictionary), 1)
                key = np.unique(w.owner()[used] * size + to[w.codes][used])
                at, code = pa.array(key // size), pa.array(key % size)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at).cast(pa.int64()), b.column(1).take(at), coded.dictionary.take(code).cast(pa.string()), pa.array(np.full(len(key), whole))],
                    names=["id", "y", "word", "whole"],
                )

    seen = own.mapInArrow(words_of, "id long, y int, word string, whole boolean")
    counts = cut(seen.groupBy("word", "whole").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean")))
    rare = (F.col("toxic") >= 3) & (F.col("toxic") * (n_clean + 1) >= 5 * (F.col("clean") + 0.3) * (n_toxic + 1))
    suspects = counts.where(rare).groupBy("word").agg(F.max("toxic").alias("toxic"), F.max("clean").alias("clean"))
    # words of at most MAX_DOCUMENTS documents, lists of at most so many identifiers
    found = seen.where("y = 1").join(suspects, "word").groupBy(F.col("word").alias("stem"), "clean").agg(F.collect_set("id").alias("docs")).collect()
    stems = _cover(sorted(found, key=lambda r: r["stem"]), n_toxic, n_clean, counts.where("toxic + clean >= 3").count())
    begins = F.col("word").rlike("^(" + "|".join(stems) + ")") if stems else F.lit(False)
    words = counts.where("whole")
    frequent = words.where(begins & (F.col("toxic") > 0)).orderBy(F.desc("toxic"), "word").collect() if stems else []
    positive = [v for w in stems for v in variants(w, 24, 1)] + [v for r in frequent for v in variants(r["word"], 1, 2)]
    ordinary = words.where(~begins & (F.col("clean") > 0))
    common = [r["word"] for r in ordinary.orderBy(F.desc("clean"), "word").limit(MAX_WORDS // 3).collect()]
    spread = [r["word"] for r in ordinary.orderBy(F.xxhash64("word"), "word").limit(MAX_WORDS // 3).collect()]
    negative = list(dict.fromkeys(common + spread))
    machine = train_machine(positive, negative)
    if positive and negative:
        # clean words that come close are the ones to learn from

        def close(batches, machine=machine):
            for b in blocks(batches):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(machine.margins(b.column(0).to_pylist()), pa.float32())], names=["word", "m"])

        near = ordinary.select("word").mapInArrow(lambda it: close(it), "word string, m float")
        hard = near.orderBy(F.desc("m"), "word").limit(MAX_WORDS // 3).collect()
        machine = train_machine(positive, list(dict.fromkeys(negative + [r["word"] for r in hard])))
    machine.stems = tuple(stems)
    final = machine

    def judged(batches):
        for b in blocks(batches):
            e = document_evidence(b.column(2), final)
            yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(e[:, i]) for i in range(5))], names=["y", *"abcde"])

    got = own.mapInArrow(judged, "y int, a double, b double, c double, d double, e double").collect()
    if n_toxic and n_clean:
        machine.logistic = _logistic(np.array([[r[c] for c in "abcde"] for r in got]), np.array([r["y"] for r in got]))
    return machine


def score(docs: DataFrame, machine: Machine, threshold: float = 0.5, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``held_out``, ``score`` and ``predicted``. Null and empty texts get
    the score of a text without any likeness to an insult; repeated rows are scored
    each; an empty table gives an empty result; other columns are ignored."""
    kind = dict(docs.dtypes)[id_col]

    def of(batches):
        for b in blocks(batches):
            p = machine.probability(document_evidence(b.column(1), machine))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], names=["id", "score"])

    made = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t")).mapInArrow(of, f"id {kind}, score double")
    return made.select(
        F.col("id").alias(id_col),
        (F.crc32(F.col("id").cast("string")) % folds == held).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the labelled part and score every document."""
    return score(docs, train(docs, labels, folds, held, id_col, text_col), threshold, folds, held, id_col, text_col)
