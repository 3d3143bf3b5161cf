"""Fingerprints, SentencePiece, packing, exact dedup and WARC against brute force."""

import gzip
import hashlib
import os
import random
import struct
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from reprolens.llm import exact_dedup, fingerprints, packing, spm, warc
from reprolens.llm._common import Words, blocks
from reprolens.llm.queries import vocabulary

ODD = [None, "", " ", "a", "same", "same", "Ä é\n\nñ 中文 😀", "x" * 5000, "word " * 3000, "it's <|endoftext|> x<|ENDOFTEXT|>", "\x00\x1c\x85 b", "  two  spaces  "]


def docs(spark, texts, **extra):
    rows = [(i * 3, t, "en", "src", 0 if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # columns whose names operators use inside
    return df.withColumns({"_t": F.lit("x"), "t": F.lit(1), "id": F.lit(2), "label": F.lit("z")})


def empty(spark):
    return docs(spark, ["x"]).limit(0)


def test_words_of_sliced_batches():
    texts = [f"É{i} b{i}  C\x0b{i} d" for i in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    got = []
    for b in blocks([batch], 500):
        w = Words(b.column(0))
        vocab = w.vocab.to_pylist()
        got += [[vocab[c] for c in w.codes[w.starts[i] : w.starts[i + 1]]] for i in range(len(w))]
    assert got == [[x.decode() for x in t.encode().lower().split()] for t in texts]


def test_merkle_tree_and_edits(spark):
    a = "one two three\nfour five\n\nsix seven eight\nnine ten"
    b = a.replace("five", "fiver")
    fa, fb = fingerprints.Tree(a).text(), fingerprints.Tree(b).text()
    assert fa != fb and fingerprints.likeness(fa, fa) == 1 and 0 < fingerprints.likeness(fa, fb) < 1
    assert fingerprints.differing(fa, fb) == [(0, 1)] and fingerprints.differing(fa, fa) == []
    t = fingerprints.Tree(a)
    assert [len(s[1]) for s in t.sections] == [3, 2]
    assert sum(p[2] for _, ps in t.sections for p in ps) == len(a.encode())
    assert fingerprints.Tree("").sections == []
    got = fingerprints.fingerprints(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and len({r["root"] for r in got}) == len(set(t or "" for t in ODD))
    assert fingerprints.fingerprints(empty(spark)).count() == 0


def brute_fingerprint(text):
    """The tree by its definition, byte by byte: pieces (one list a paragraph, one list of these a section), and the root."""
    raw = text.encode()
    digest = lambda x: hashlib.blake2b(x, digest_size=16).digest()
    mask = (1 << 32) - 1

    def cuts_at(i):
        if raw[i] == 10:
            return True
        if raw[i] not in (32, 9, 11, 12, 13):
            return False
        h = sum(raw[i - k] * f for k, f in ((1, 0x9E3779B1), (2, 0x85EBCA6B), (3, 0xC2B2AE35), (4, 0x27D4EB2F)) if i - k >= 0) & mask
        h = (h ^ (h >> 15)) * 0x2C1B3C6D & mask
        return (h ^ (h >> 13)) % 4 == 0

    sections, paragraphs, pieces, start = [], [], [], 0
    for i in range(len(raw)):
        last = i == len(raw) - 1
        if cuts_at(i) or last:
            part = raw[start : i + 1]
            pieces += [part] if len(part) <= 64 else [part[k : k + 32] for k in range(0, len(part), 32)]
            start = i + 1
        if raw[i] == 10 or last:
            paragraphs.append(pieces)
            pieces = []
            if last or (raw[i] == 10 and i > 0 and raw[i - 1] == 10 and raw[i + 1] != 10):
                sections.append(paragraphs)
                paragraphs = []
    root = digest(b"r" + b"".join(digest(b"s" + b"".join(digest(b"p" + b"".join(map(digest, ps))) for ps in sec)) for sec in sections))
    return root.hex(), sections, [digest(x)[:4] for sec in sections for ps in sec for x in ps]


def test_merkle_against_definition():
    r = random.Random(12)
    texts = ["", "\n", "\n\n", "a\n\n\nb", "x" * 200] + ["".join(r.choice(["ab", "the ", "é", "\n", "\n\n", " ", "word "]) for _ in range(r.randint(1, 250))) for _ in range(60)]
    texts += [t[: len(t) // 2] + "new" + t[len(t) // 2 :] for t in texts]
    trees, want = [fingerprints.Tree(t) for t in texts], [brute_fingerprint(t) for t in texts]
    for t, tree, (root, sections, _) in zip(texts, trees, want, strict=True):
        assert tree.root == root and [len(ps) for _, ps in tree.sections] == [len(sec) for sec in sections], t
        assert b"".join(x for sec in sections for ps in sec for x in ps) == t.encode()
    for i, j in [(i, len(texts) // 2 + i) for i in range(len(texts) // 2)] + [(r.randrange(len(texts)), r.randrange(len(texts))) for _ in range(200)]:
        a, b = Counter(want[i][2]), Counter(want[j][2])
        same, total = sum((a & b).values()), sum(a.values()) + sum(b.values())
        plain = 1.0 if want[i][0] == want[j][0] else same / (total - same)
        assert fingerprints.likeness(trees[i].text(), trees[j].text()) == pytest.approx(plain)
        assert fingerprints.likeness_of(trees[i].branches(), trees[j].branches()) == pytest.approx(plain)


def test_edits_are_located():
    parts = [f"para {i} of this text, line {i}\n" + ("\n" if i % 4 == 3 else "") for i in range(16)]
    a = fingerprints.Tree("".join(parts)).text()
    changed = list(parts)
    changed[5], changed[14] = changed[5].replace("text", "test"), changed[14].replace("para", "Para")
    b = fingerprints.Tree("".join(changed)).text()
    assert fingerprints.differing(a, b) == fingerprints.differing(b, a) == [(1, 1), (3, 2)]


def test_edited_neighbours(spark):
    r = random.Random(3)
    texts = ODD + [" ".join(r.choice("alpha beta gamma\n delta".split(" ")) for _ in range(r.randint(1, 200))) for _ in range(60)]
    got = fingerprints.edited_neighbours(docs(spark, texts).repartition(5), ranges=7).orderBy("doc_id").collect()
    plain = [t or "" for t in texts]
    assert len(got) == len(plain)
    for i, g in enumerate(got):
        own, after = plain[i], plain[(i + 1) % len(plain)]
        edit = own[: len(own) - len(own) // 4] + after[: len(own) // 4]
        assert g["n_chars"] == len(own) and g["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        assert g["edited_fingerprint"] == fingerprints.Tree(edit).text()
        assert g["near_edited"] == pytest.approx(fingerprints.likeness(g["fingerprint"], g["edited_fingerprint"]))
        assert g["near_next"] == pytest.approx(fingerprints.likeness(g["fingerprint"], fingerprints.Tree(after).text()))
    assert fingerprints.edited_neighbours(empty(spark)).count() == 0
    assert fingerprints.edited_neighbours(docs(spark, ["abcd"])).collect()[0]["near_next"] == 1.0


def test_sentencepiece_parity_and_round_trip(spark):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    other = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(5)
    texts = [t or "" for t in ODD] + ["".join(r.choice("ab  e▁t\nhé﷐") for _ in range(60)) for _ in range(300)]
    c = spm.Codec(path)
    assert [x.tolist() for x in c.encode(pa.array(texts))] == other.encode(texts)
    assert [c.decode(x) for x in other.encode(texts)] == [other.decode(x) for x in other.encode(texts)]
    enc = spm.encode(docs(spark, ODD), path, threads=2)
    dec = {x["doc_id"]: x["text"] for x in spm.decode(enc, path).collect()}
    assert [dec[i * 3] for i in range(len(ODD))] == [t or "" for t in ODD]
    got = spm.verify(docs(spark, ODD), path).collect()
    assert all(g["parity"] and g["round_trip"] for g in got)
    assert spm.encode(empty(spark), path).count() == 0


def test_sentencepiece_forgets_chunks():
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    other = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(6)
    c, seen = spm.Codec(path, most=3000), []
    for _ in range(40):
        texts = ["".join(r.choice("abe▁ ") for _ in range(r.randint(0, 40))) for _ in range(20)] + ["the cat " * 3, "x" * 4000 * r.randint(0, 1)]
        assert [x.tolist() for x in c.encode(pa.array(texts))] == other.encode(texts)
        assert c.known.nbytes + c.flat.nbytes <= 3000 and len(c.known) == len(c.sizes) == len(c.hits) and c.sizes.sum() == len(c.flat)
        seen.append(set(c.known.to_pylist()))
    assert any(len(x) < len(y) for x, y in zip(seen[1:], seen, strict=False)) and sum("▁cat" in x for x in seen) > 20


def test_sentencepiece_worker_memory(spark, tmp_path, monkeypatch):
    """Two workers share an executor's 3,000 MB with its JVM; one took 960 MB."""
    made = []
    df = docs(spark, ["x"])
    whole = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a, **b: made.append(f) or whole(self, f, *a, **b))
    spm.verify(df, vocabulary("piece_bpe_32k.model"))
    (tmp_path / "f").write_bytes(cloudpickle.dumps(made[0]))
    code = """
import pickle, re, sys
import numpy as np, pyarrow as pa
r = np.random.default_rng(1)
words = np.array(["".join(chr(97 + k // 26**i % 26) for i in range(5)) for k in r.permutation(400_000)], object)
def peak():
    return int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) >> 10
def batches():
    for k in range(2):
        at = np.where(r.random((5000, 350)) < 0.5, r.integers(0, 2000, (5000, 350)), r.integers(0, len(words), (5000, 350)))
        yield pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array([" ".join(x) for x in words[at]])], names=["id", "t"])
f, parts = pickle.load(open(sys.argv[1], "rb")), list(batches())
before = peak()
assert all(b.num_rows and all(b.column(3).to_pylist()) and all(b.column(4).to_pylist()) for b in f(parts))
print(peak() - before)
"""
    root = str(Path(spm.__file__).parents[2])
    said = subprocess.run([sys.executable, "-B", "-c", code, str(tmp_path / "f")], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, check=True)
    assert int(said.stdout) < 300


def field(number, value):
    """One protobuf field: varint, float or bytes."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


@pytest.mark.parametrize("fallback", [0, 1])
def test_unigram_parity(tmp_path, fallback):
    """A model file written by hand: control, unknown, user-defined and byte pieces, against the library."""
    import sentencepiece

    r = random.Random(2)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("<user>", 0.0, 4), ("old", -1.0, 5)]
    if fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    own = {"▁", *"abcdos</>0x41ru"} | {r.choice(["", "▁"]) + "".join(r.choices("abcdos<>", k=r.randint(2, 4))) for _ in range(120)}
    pieces += [(p, -r.uniform(1, 12), 1) for p in sorted(own - {"<s>", "old"})]
    data = b"".join(field(1, field(1, p.encode()) + field(2, float(s)) + field(3, t)) for p, s, t in pieces)
    data += field(2, field(3, 1) + field(35, fallback)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))
    path = tmp_path / "m.model"
    path.write_bytes(data)
    other = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["", "a<s>b", "</s> <unk>", "<0x41>", "x <user> ab<user>", "old ab", "é😀a", "a  b", *("".join(r.choices("abcdos<> /0x41éu", k=r.randint(1, 40))) for _ in range(200))]
    c = spm.Codec(str(path))
    got, want = [x.tolist() for x in c.encode(pa.array(texts))], other.encode(texts)
    # c|cc and cc|c score the same: of equal segmentations each library takes its own
    assert [sorted(x) for x in got] == [sorted(x) for x in want] and sum(x != y for x, y in zip(got, want, strict=True)) <= 4
    assert {1, 2} & {i for x in c.encode(pa.array(texts)) for i in x.tolist()} == set()
    with pytest.raises(ValueError):
        spm.Model.parse(bytes([0x12, 2, 0x18, 3]))


def test_token_pieces(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = {}
    for i, t in enumerate(ODD):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 100)):
            want[i * 3, k] = (at, len(ids[at : at + 100]), zlib.crc32(ids[at : at + 100].tobytes()))
    got = packing.pieces(docs(spark, ODD), vocabulary("word_bpe_49k.json"), capacity=100).collect()
    assert {(g["doc_id"], g["piece"]): (g["start"], g["length"], g["ids_crc32"]) for g in got} == want
    assert packing.pieces(empty(spark), vocabulary("word_bpe_49k.json")).count() == 0


def test_bounds_never_exceed_the_optimum():
    import itertools

    r = random.Random(1)

    def fewest(sizes):
        for n in range(1, len(sizes) + 1):
            for to in itertools.product(range(n), repeat=len(sizes)):
                if all(sum(s for s, t in zip(sizes, to, strict=True) if t == b) <= 10 for b in range(n)):
                    return n
        return 0

    for _ in range(60):
        sizes = [r.randint(1, 10) for _ in range(r.randint(1, 6))]
        best = fewest(sizes)
        assert packing.lower_bound(np.array(sizes), 10) <= best
        bins, offsets, n = packing.best_fit_decreasing(np.array(sizes), 10)
        assert n >= best and len(set(bins.tolist())) == n
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3
    assert packing.lower_bound(np.array([], dtype=int), 10) == 0


def test_packing_places_every_piece_once(spark):
    r = random.Random(2)
    rows = [(i, 0, 0, r.randint(1, 100), i) for i in range(800)] + [(7, 0, 0, 40, 7)] * 200
    df = spark.createDataFrame(rows, packing.PIECES)
    got = packing.pack(df, capacity=100, group_rows=150).toPandas()
    assert len(got) == len(rows) and sorted(got.length) == sorted(x[3] for x in rows)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 100
    # groups that exchange pieces come close to one packing of everything
    assert got.sequence_id.nunique() <= packing.best_fit_decreasing(got.length.to_numpy(), 100)[2] * 1.01 + 1
    assert packing.pack(df.limit(0)).count() == 0
    # every certificate holds: a group never takes fewer sequences than its bound, and the last round's need not exchange
    assert (got.group_sequences >= got.group_bound).all() and (got.group_bound > 0).all()
    with pytest.raises(ValueError):
        packing.pack(df, capacity=50)


def test_exchange_ends(spark):
    """Pieces of which no group can meet its bound: beyond any fixed number of rounds, each is placed once."""
    rows = [(i, 0, 0, 51 + i % 7, i) for i in range(400)] + [(1000 + i, 0, 0, 34, i) for i in range(400)]
    got = packing.pack(spark.createDataFrame(rows, packing.PIECES), capacity=100, group_rows=20).toPandas()
    assert sorted(got.doc_id) == sorted(x[0] for x in rows) and got.groupby("sequence_id").length.sum().max() <= 100


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_of_any_tokenizer(name):
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(vocabulary(name)), packing.ChunkEncoder(vocabulary(name), packing.chunked(vocabulary(name)))
    texts = ["Hello World 12", "", "it's  Ünï\n<|endoftext|> x1y", *(t or "" for t in ODD)]
    assert [x.tolist() for x in enc.batch(pa.array(texts))] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert enc.by_chunk == (name == "word_bpe_49k.json")


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("hot", [1, 2000])
def test_exact_groups(spark, keep, hot):
    texts = [*ODD, *["hot"] * 50, "Same", "y" * 40 + "1", "y" * 40 + "2", "y" * 40 + "1"]
    got = {g["doc_id"]: g for g in exact_dedup.exact_groups(docs(spark, texts), keep=keep, hot_groups=hot).collect()}
    plain = [t or "" for t in texts]
    pick = min if keep == "min" else max
    for i, t in enumerate(plain):
        same = [j * 3 for j, u in enumerate(plain) if u == t]
        g = got[i * 3]
        assert (g["keep_id"], g["group_size"], g["kept"]) == (pick(same), len(same), pick(same) == i * 3)
        assert g["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    wide = docs(spark, texts).withColumn("a.b", F.lit("c"))
    left = exact_dedup.deduplicate(wide, keep=keep, hot_groups=hot)
    assert left.columns == wide.columns and left.select("`a.b`").distinct().count() == 1
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(pick(j * 3 for j, u in enumerate(plain) if u == t) for t in set(plain))


def test_exact_dedup_edges(spark):
    assert exact_dedup.exact_groups(empty(spark)).count() == 0 and exact_dedup.deduplicate(empty(spark)).count() == 0
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b"), (1, "b"), (None, "b")], "doc_id long, text string")
    got = exact_dedup.exact_groups(df).collect()
    assert sorted((str(g["keep_id"]), g["group_size"], g["kept"]) for g in got) == [("1", 3, False), ("1", 3, True), ("1", 3, True), ("None", 2, True), ("None", 2, True)]
    assert exact_dedup.deduplicate(df).count() == 2
    folded = exact_dedup.exact_groups(spark.createDataFrame([(1, "A "), (2, "a")], "doc_id long, text string"), normalise=lambda c: F.lower(F.trim(c)))
    assert {g["keep_id"] for g in folded.collect()} == {1}


def test_warc_round_trip(spark, tmp_path):
    big = "x" * 1200 + "\r\n\r\nWARC/1.1\r\né"
    rows = [(1, "http://a.b/c d", big), (2, None, big), (3, "u", None), (4, "https://z.y/", "short"), (5, "q", "short"), (9, "http://a.b/c", big), (None, "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("body", F.lit("z"))
    got = {g["page_id"]: g for g in warc.page_digests(df).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 9]
    for i, _, h in rows[:-1]:
        raw = (h or "").encode()
        assert got[i]["payload_bytes"] == len(raw) and got[i]["payload_digest"] == hashlib.sha1(raw).hexdigest()
    assert {i: (g["record_type"], g["refers_to"]) for i, g in got.items()} == {
        1: ("revisit", 9), 2: ("revisit", 9), 3: ("response", None), 4: ("response", None), 5: ("response", None), 9: ("response", None),
    }
    c = warc.archive_and_read(df, str(tmp_path / "w"), payloads=True, codec=None).collect()
    by = {x["capture_id"]: x for x in c}
    one = by["<urn:page:response:9>"]
    assert bytes(one["response"]["payload"]).decode() == big and one["request"]["concurrent_to"] == one["capture_id"] == one["metadata"]["concurrent_to"]
    assert warc.page_digests(df.limit(0)).count() == 0


def test_warc_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    monkeypatch.setattr(warc, "CAPTURES_PER_FILE", 20)
    rows = [(i, "http://a/b", ("x" * 9000 + str(i % 30)) if i % 2 else "small" * 300) for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    c = warc.archive_and_read(df, str(tmp_path / "w"), payloads=True, codec=None).collect()
    assert len(c) == 120 and sum(x["response"]["type"] == "response" for x in c) == 16
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("part-*")]
    assert len(sizes) > 5 and max(sizes) < 40_000 + 20 * 3 * 600


def test_warc_parser():
    r = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    assert [(h["warc-type"], bytes(b)) for h, b in warc.parse(gzip.compress(r) + gzip.compress(r))] == [("warcinfo", b"ab\r\nc")] * 2
    for bad in (b"junk", r[:-8], r.replace(b"Content-Length: 5\r\n", b""), r.replace(b": 5", b": -5")):
        with pytest.raises(ValueError):
            list(warc.parse(bad))
