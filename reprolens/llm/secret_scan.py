"""Secret scanning with a random forest that removes false positives.

Candidates are values assigned to a password-like name, whatever their length, and
long tokens that hold a digit. Each gets features from its characters (length, class
transitions, distinct characters), from a dictionary (coverage by the letter triples
of its words, likelihood of its letter transitions among them), its path-like
surroundings and neighbouring words. A forest trained from labelled findings, a
bounded table, decides. Finding, features, forest and offsets are SQL expressions
over one row, so a scan has no shuffle: the trees become nested CASE expressions.
"""

from __future__ import annotations

import collections
import json
import math
import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import text_or_empty

#: Most labelled findings that a forest is trained from.
MAX_FINDINGS = 20_000

_NAMES = "password|passwd|pwd|secret|token|apikey|api_key|api-key|access_key|private_key"
_ASSIGNS = r"(?i:(?:" + _NAMES + r")(?:_[a-z]{1,12}+)?)[\"']?\s?[:=]\s?"
#: What is assigned to one of the names, to the closing quote or blank, or a long run
#: of token characters with a digit in it.
CANDIDATE = (
    r"(?=[aptsAPTS])" + _ASSIGNS + r"(?:\"[^\s\"]{6,}+|'[^\s']{6,}+|[^\s\"'<>,;]{6,}+)"
    r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+={0,2}"
)
#: The part of a candidate that is the name.
_PREFIX = "^" + _ASSIGNS + "[\"']?"
#: Elements of one step of the running sums of offsets.
_STEP = 256
FEATURES = (
    "length", "digits", "lowers", "uppers", "marks", "transitions", "distinct", "coverage", "likelihood", "vowels", "longest_letters",
    "hex", "numeric", "grouped", "vendor", "asked", "assigned", "quoted", "path", "suffix", "explained", "mail",
)


def vocabulary_words(path: str) -> list[str]:
    """The whole words of four letters or more in a public tokenizer's vocabulary with word ends."""
    with open(path, encoding="utf-8") as f:
        entries = json.load(f)["model"]["vocab"]
    return [w.removesuffix("</w>") for w in entries if re.fullmatch(r"[a-z]{4,}</w>", w)]


#: Words that stand for a dictionary where none is given.
_FEW_WORDS = (
    "about after again article before between change chapter content data date example file first from have here home image "
    "index invoice item just letter line list make many model more name number only order other over page part people photo "
    "post product report right sample section some test that their them then there these they this time token user value "
    "version video view water were what when where which will with word work would write year your"
).split()


@dataclass(frozen=True)
class Dictionary:
    """Letter triples of words as a bit set (275 longs), and the log2 odds of each of the
    676 letter transitions against chance."""

    triples: tuple[int, ...]
    transitions: tuple[float, ...]

    @classmethod
    def of(cls, words: list[str], share: float = 0.9) -> Dictionary:
        """The most frequent triples that make up ``share`` of all in the words."""
        words = [w for w in words if re.fullmatch("[a-z]+", w)]
        code = lambda s: sum((ord(c) - 97) * 26**i for i, c in enumerate(reversed(s)))
        three = collections.Counter(code(w[i : i + 3]) for w in words for i in range(len(w) - 2))
        two = collections.Counter(code(w[i : i + 2]) for w in words for i in range(len(w) - 1))
        bits, left = [0] * 275, share * sum(three.values())
        for t, n in sorted(three.items(), key=lambda x: (-x[1], x[0])):
            if left <= 0:
                break
            bits[t // 64] |= 1 << (t % 64)
            left -= n
        total = sum(two.values())
        odds = [math.log2((two[i] + 0.5) / (total + 338) * 676) for i in range(676)]
        return cls(tuple(b - (1 << 64) if b >> 63 else b for b in bits), tuple(round(o, 3) for o in odds))

    def features(self, low: Column) -> tuple[Column, Column]:
        """Of a lower-case value: the share of characters within a triple of the
        dictionary, and the mean log2 odds of neighbouring letters."""
        let = lambda made, then: F.element_at(F.transform(F.array(made), then), 1)
        triples, odds = F.array(*map(F.lit, self.triples)), F.array(*map(F.lit, self.transitions))
        letters = F.transform(F.split(low, ""), lambda c: F.when(c.between("a", "z"), F.ascii(c) - 97))

        def covered(at: Column) -> Column:
            places = F.sequence(F.lit(0), F.size(at) - 1)
            three = lambda i: (F.get(at, i) * 26 + F.get(at, i + 1)) * 26 + F.get(at, i + 2)
            bit = lambda t: F.coalesce(F.getbit(F.get(triples, F.floor(t / 64).cast("int")), t % 64) == 1, F.lit(False))
            hits = F.transform(places, lambda i: bit(three(i)))
            hit = lambda h, i: F.coalesce(F.get(h, i), F.lit(False))
            return let(hits, lambda h: F.size(F.filter(places, lambda i: hit(h, i) | hit(h, i - 1) | hit(h, i - 2))) / F.size(at))

        def likely(at: Column) -> Column:
            pairs = F.transform(F.sequence(F.lit(0), F.size(at) - 1), lambda i: F.get(odds, F.get(at, i) * 26 + F.get(at, i + 1)))
            known = F.filter(pairs, lambda o: o.isNotNull())
            return let(known, lambda o: F.aggregate(o, F.lit(0.0), lambda x, y: x + y) / F.greatest(F.size(o), F.lit(1)))

        return let(letters, covered), let(letters, likely)


def _of_class(value: Column, chars: str) -> Column:
    """Share of characters outside ASCII class ``chars`` subtracted from one."""
    return (F.length(value) - F.length(F.regexp_replace(value, f"[{chars}]", ""))) / F.length(value)


def _features(value: Column, before: Column, after: Column, words: Dictionary) -> Column:
    low = F.lower(value)
    runs = F.transform(F.split(value, "[^A-Za-z]+"), F.length)
    flag = lambda c: c.cast("double")
    coverage, likelihood = words.features(low)
    found = {
        "length": F.length(value).cast("double"),
        "digits": _of_class(value, "0-9"),
        "lowers": _of_class(value, "a-z"),
        "uppers": _of_class(value, "A-Z"),
        "marks": _of_class(value, "^A-Za-z0-9"),
        "transitions": F.regexp_count(value, F.lit("[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])")) / F.length(value),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.length(value),
        "coverage": coverage,
        "likelihood": likelihood,
        "vowels": _of_class(low, "aeiou"),
        "longest_letters": F.array_max(runs).cast("double"),
        "hex": flag(value.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        "numeric": flag(value.rlike(r"^[0-9/_+-]+$")),
        "grouped": F.regexp_count(value, F.lit("[/_-]")).cast("double"),
        "vendor": flag(value.rlike("^(AKIA|ASIA)[A-Z0-9]{12,}$|^gh[pousr]_|^sk-|^xox[abprs]-|^AIza|^glpat-")),
        "asked": flag(before.rlike("(?i)(" + _NAMES + r"|credential|bearer|auth)[a-z_]{0,13}[\"']?\s{0,2}[:=]?\s{0,2}[\"']?$")),
        "assigned": flag(before.rlike("[:=]\\s{0,2}[\"']?$")),
        "quoted": flag(before.rlike("[\"'`]$")),
        "path": flag(before.rlike(r"(://|www\.|[/.~?&#%])[^\s]*$")) + flag(value.rlike("^/|[a-z]/[a-z]")),
        "suffix": flag(after.rlike(r"^\.[A-Za-z0-9]{2,5}\b|^[?&#%/]")),
        "explained": flag(before.rlike(r"(?i)(commit|sha-?\d*|md5|digest|checksum|hash|uuid|guid|isbn|iban|order|invoice|phone|tel|fax|call|rev|id|no|nr|serial)[^A-Za-z0-9]{0,4}$")),
        "mail": flag(after.rlike("^[.\\w+-]*@")),
    }
    return F.struct(*(found[n].alias(n) for n in FEATURES))


def _candidates(docs: DataFrame, id_col: str, text_col: str, words: Dictionary, keep: tuple[str, ...] = ()) -> DataFrame:
    """_id, _t, _values, _gaps (the text before, between and after them) and _feats
    (arrays in order; null where a text has no candidate)."""
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t"), *keep)
    rows = rows.withColumn("_found", F.regexp_extract_all("_t", F.lit(CANDIDATE), 0))
    some = F.size("_found") > 0
    rows = rows.withColumn("_names", F.when(some, F.transform("_found", lambda m: F.regexp_extract(m, _PREFIX, 0)))).withColumn("_rest", F.when(some, F.split("_t", CANDIDATE, -1)))
    # a name belongs to the text before its value
    rows = rows.withColumn("_values", F.when(some, F.zip_with("_found", "_names", lambda m, n: F.substr(m, F.length(n) + 1))))
    rows = rows.withColumn("_gaps", F.when(some, F.transform("_rest", lambda g, i: F.concat(g, F.coalesce(F.get("_names", i), F.lit(""))))))
    one = lambda i: _features(
        F.get("_values", i), F.right(F.get("_gaps", i), F.lit(48)), F.left(F.concat(F.get("_rest", i + 1), F.coalesce(F.get("_names", i + 1), F.lit(""))), F.lit(32)), words
    )
    rows = rows.withColumn("_feats", F.when(some, F.transform(F.sequence(F.lit(0), F.size("_values") - 1), one)))
    return rows.drop("_found", "_names", "_rest")


def labelled_findings(n: int = 3000, seed: int = 11) -> list[tuple[str, int]]:
    """Labelled findings for training: texts with one candidate each, 1 for a secret.

    Invented from public shapes of credentials and of what is mistaken for them.
    """
    r = random.Random(seed)
    of = lambda chars, k: "".join(r.choices(chars, k=k))
    lower, upper, digit, hexa = string.ascii_lowercase, string.ascii_uppercase, string.digits, "0123456789abcdef"
    b64 = lower + upper + digit + "+/"
    parts = "the an er on re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ein sch ung que ent aux ado".split()
    word = lambda: "".join(r.choices(parts, k=r.randint(1, 4)))
    words = lambda k: " ".join(word() for _ in range(k))
    name = lambda: r.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth_token"])
    ask = lambda: r.choice([f"{name()}=", f"{name()}: ", f'{name()} = "', f"{name()} = '", f'"{name()}": "', f"{name()} "])
    yes = [
        lambda: "AKIA" + of(upper + digit, 16),
        lambda: r.choice(["aws key ", "", "key=", "id: "]) + "AKIA" + of(upper + digit, 16),
        lambda: ask() + of(hexa, r.choice([16, 18, 20, 24, 32, 40, 48, 64])),
        lambda: ask() + of(lower + upper + digit, r.randint(16, 48)),
        lambda: ask() + of(b64, 40),
        lambda: r.choice(["", ask(), "use "]) + r.choice(["ghp_", "gho_", "ghs_"]) + of(lower + upper + digit, 36),
        lambda: r.choice(["", ask(), "key "]) + "sk-" + of(lower + upper + digit, r.randint(32, 48)),
        lambda: r.choice(["", ask()]) + "xoxb-" + of(digit, 11) + "-" + of(lower + upper + digit, 24),
        lambda: r.choice(["", ask()]) + "AIza" + of(lower + upper + digit + "_-", 35),
        lambda: r.choice(["password", "pwd", "passwd"]) + r.choice(["=", ": "]) + of(lower + upper + digit + "!@#%", r.randint(8, 20)),
        lambda: "Bearer " + of(lower + upper + digit + "_-", r.randint(30, 60)),
    ]
    no = [
        lambda: r.choice(["", "id ", "uuid: "]) + "-".join(of(hexa, k) for k in (8, 4, 4, 4, 12)),
        lambda: r.choice(["commit ", "sha1 ", "sha256:", "md5 ", "checksum: ", "digest=", "rev "]) + of(hexa, r.choice([32, 40, 64])),
        lambda: "https://" + word() + ".example/" + "-".join(word() for _ in range(r.randint(2, 5))) + "-" + of(digit, r.randint(2, 8)) + r.choice([".html", "/", ""]),
        lambda: "see /" + word() + "/" + word() + "/" + word() + of(digit, 3) + r.choice([".png", ".jpg", ".txt", ""]),
        lambda: r.choice(["call ", "phone ", "tel: ", "", "+"]) + "-".join([of(digit, 3), of(digit, 3), of(digit, 4)]),
        lambda: r.choice(["card ", "order ", "isbn ", "", "invoice no "]) + of(digit, r.randint(12, 19)),
        lambda: r.choice(["iban ", ""]) + of(upper, 2) + of(digit, r.randint(14, 22)),
        lambda: f"20{of(digit, 2)}-0{r.randint(1, 9)}-1{of(digit, 1)}T1{of(digit, 1)}" + r.choice(["", "-30"]),
        lambda: word() + word() + word() + of(digit, r.randint(1, 4)),
        lambda: "-".join(word() for _ in range(r.randint(3, 6))) + "-" + of(digit, 2),
        lambda: "_".join(word() for _ in range(r.randint(3, 6))) + of(digit, 2),
        lambda: r.choice(["IMG_", "DSC_", "chapter", "section", "figure_"]) + of(digit, 8) + r.choice(["", "_1234"]),
        lambda: ask() + r.choice(["changeme123", "your_token_here1", "example123456", "xxxxxxxxxxxx1", "password1234", "000000000000", "<your-key-1>"]),
        lambda: "base64," + of(b64, r.randint(300, 900)) + "==",
        lambda: word() + of(lower, 3) + of(digit, 12)[: r.randint(6, 12)] + "@mail" + of(digit, 1) + ".example.com",
        lambda: r.choice(["v", "version "]) + "-".join(of(digit, r.randint(1, 3)) for _ in range(5)),
        lambda: r.choice(["#", "id=", "class="]) + word() + "-" + word() + "-" + of(hexa, 6) + of(digit, 2),
    ]
    out = []
    for i in range(min(n, MAX_FINDINGS)):
        label = i % 2
        made = r.choice(yes if label else no)()
        tail = r.choice(["", '"' if '"' in made else "", ".", ","])
        out.append((f"{words(r.randint(0, 6))} {made}{tail} {words(r.randint(0, 6))}", label))
    return out


class Forest:
    """Random forest of shallow trees grown in numpy; ``expression`` compiles it to SQL."""

    def __init__(self, words: Dictionary, trees: int = 15, depth: int = 6, least: int = 5, seed: int = 3):
        self.words, self.trees, self.depth, self.least, self.seed = words, trees, depth, least, seed
        self.roots: list = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        r = np.random.default_rng(self.seed)
        tries = max(1, int(np.ceil(np.sqrt(x.shape[1]))) + 1)

        def grow(rows: np.ndarray, depth: int):
            p = y[rows].mean()
            if depth == 0 or len(rows) < 2 * self.least or p in (0, 1):
                return float(p)
            best = (p * (1 - p) * len(rows) - 1e-9, None, None)
            for j in r.choice(x.shape[1], tries, replace=False):
                order = np.argsort(x[rows, j], kind="stable")
                v, t = x[rows[order], j], np.cumsum(y[rows[order]])
                cut = np.flatnonzero(v[1:] > v[:-1]) + 1
                cut = cut[(cut >= self.least) & (cut <= len(rows) - self.least)]
                if not len(cut):
                    continue
                left, right = t[cut - 1] / cut, (t[-1] - t[cut - 1]) / (len(rows) - cut)
                loss = cut * left * (1 - left) + (len(rows) - cut) * right * (1 - right)
                k = int(np.argmin(loss))
                if loss[k] < best[0]:
                    best = (loss[k], int(j), float((v[cut[k] - 1] + v[cut[k]]) / 2))
            if best[1] is None:
                return float(p)
            below = x[rows, best[1]] <= best[2]
            return (best[1], best[2], grow(rows[below], depth - 1), grow(rows[~below], depth - 1))

        self.roots = [grow(r.integers(0, len(y), len(y)), self.depth) for _ in range(self.trees)]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        def walk(node, row):
            while not isinstance(node, float):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            return node

        return np.array([np.mean([walk(t, row) for t in self.roots]) for row in x])

    def expression(self, features: Column) -> Column:
        def of(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            return F.when(features[FEATURES[node[0]]] <= node[1], of(node[2])).otherwise(of(node[3]))

        total = of(self.roots[0])
        for t in self.roots[1:]:
            total = total + of(t)
        return total / len(self.roots)


def train(spark: SparkSession, findings: list[tuple[str, int]] | None = None, words: list[str] | None = None) -> Forest:
    """Forest from labelled findings (text with a candidate, 0 or 1); at most
    ``MAX_FINDINGS`` of them are used, and of each text its last candidate; texts without
    one are left out. ``words`` are the dictionary. Features come from the same SQL
    expressions as those of a scan. No findings at all raise ValueError."""
    rows = (labelled_findings() if findings is None else findings)[:MAX_FINDINGS]
    if not rows:
        raise ValueError("no labelled findings")
    # an Arrow table becomes rows without Python workers
    given = spark.createDataFrame(pa.table({"id": pa.array(range(len(rows)), pa.int64()), "text": pa.array([t for t, _ in rows], pa.string()), "y": pa.array([y for _, y in rows], pa.int32())}))
    forest = Forest(Dictionary.of(words or _FEW_WORDS))
    made = _candidates(given, "id", "text", forest.words, ("y",))
    got = made.select("_id", "y", F.try_element_at("_feats", F.lit(-1)).alias("f")).orderBy("_id").collect()
    got = [g for g in got if g["f"] is not None]
    x = np.array([[float(v) for v in g["f"]] for g in got])
    return forest.fit(x, np.array([float(g["y"]) for g in got]))


def _running(sizes: Column) -> Column:
    """Sum of the elements before each one: within steps of ``_STEP`` elements, and over these."""
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    let = lambda made, then: F.element_at(F.transform(F.array(made), then), 1)
    steps = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _STEP).cast("int"))
    sums = F.transform(steps, lambda s: add(F.slice(sizes, s * _STEP + 1, F.lit(_STEP))))
    bases = let(sums, lambda own: F.transform(steps, lambda s: add(F.slice(own, F.lit(1), s))))
    first = lambda i: F.floor(i / _STEP).cast("int")
    return let(bases, lambda b: F.transform(sizes, lambda _, i: F.get(b, first(i)) + add(F.slice(sizes, first(i) * _STEP + 1, i % _STEP))))


def scan(docs: DataFrame, forest: Forest, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate: id, ``start`` (code points before it), ``length``,
    ``value_sha256`` (the value itself is not repeated), ``score`` and ``is_secret``.

    Null and empty texts have none. Repeated rows report theirs each. A text of any
    length is read whole; a value found twice is reported twice. An empty table gives
    an empty result. Other columns are ignored.
    """
    rows = _candidates(docs, id_col, text_col, forest.words)
    rows = rows.select("_id", "_values", F.slice("_gaps", F.lit(1), F.size("_values")).alias("_gaps"), F.transform("_feats", forest.expression).alias("_scores"))
    sizes = F.zip_with("_values", "_gaps", lambda v, g: (F.length(v) + F.length(g)).cast("long"))
    rows = rows.withColumn("_sizes", sizes)
    # no array of the row is named within a lambda, and no filter stands on one: the
    # optimizer would make it again for each element, or pushed below what makes it
    before = F.when(F.col("_sizes").isNotNull(), _running(F.col("_sizes"))).alias("_before")
    each = rows.select("_id", F.explode_outer(F.arrays_zip("_values", "_gaps", "_scores", before)).alias("c")).where("c is not null")
    return each.select(
        F.col("_id").alias(id_col),
        (F.col("c._before") + F.length("c._gaps")).alias("start"),
        F.length("c._values").alias("length"),
        F.sha2("c._values", 256).alias("value_sha256"),
        F.col("c._scores").alias("score"),
        (F.col("c._scores") >= threshold).alias("is_secret"),
    )


def redact(docs: DataFrame, forest: Forest, threshold: float = 0.5, mark: str = "<SECRET>", text_col: str = "text") -> DataFrame:
    """``docs`` with each secret replaced by ``mark`` and ``n_chars``, where there is
    such a column, counted anew for changed texts. No row is dropped, repeated ones
    neither; other texts stay as they were, null and empty ones too. Further columns may
    have any name. An empty table gives an empty result."""
    names = docs.columns
    plain = docs.toDF(*(str(i) for i in range(len(names))))
    at = str(names.index(text_col))
    rows = _candidates(plain.select(F.struct(*plain.columns).alias("_r"), F.col(at).alias("_text")), "_r", "_text", forest.words)
    scores = F.when(F.col("_feats").isNotNull(), F.transform("_feats", forest.expression))
    rows = rows.withColumn("_bad", F.transform(scores, lambda s: s >= threshold))
    piece = lambda g, i: F.concat(g, F.when(F.get("_bad", i), F.lit(mark)).otherwise(F.coalesce(F.get("_values", i), F.lit(""))))
    changed = F.coalesce(F.exists("_bad", lambda b: b), F.lit(False))
    rows = rows.withColumn("_new", F.when(changed, F.array_join(F.transform("_gaps", piece), "")))
    out = []
    for i, c in enumerate(names):
        old = F.col(f"_id.{i}")
        if c == text_col:
            old = F.when(F.col("_new").isNotNull(), F.col("_new")).otherwise(old)
        elif c == "n_chars":
            old = F.when(F.col("_new").isNotNull(), F.length("_new").cast(docs.schema[i].dataType)).otherwise(old)
        out.append(old.alias(c))
    return rows.select(*out)
