import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pagewright.llm import _kernels as K
from pagewright.llm import bpe as B
from pagewright.llm import fingerprints as P
from pagewright.llm import token_files as T
from pagewright.llm._common import shared_dir

from . import fixtures as X

_PIECES = ["a", "bc", " ", "  ", "\n", "\t", "'s", "12", "é", " ", "　", "!", "​", "̈", ".", ",", "Σ", "İ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>.", "<|", "\x1c", "\x0b", "\x85", "\ue000"]


def noise(seed, n):
    r = random.Random(seed)
    return "".join(r.choice(_PIECES) for _ in range(r.randrange(n)))


def test_tree_encoding_equals_the_library():
    for leaf in (2, 7, 64):
        c = B.TreeCodec(B.load_ranks(public_tokenizers.path(B.RANKS)), public_tokenizers.PATTERN, leaf)
        for text in [*(noise(i, 200) for i in range(300)), *((r[1] or "")[:4000] for r in X.rows())]:
            ids = c.encode(text)
            assert ids == c.encoding.encode_ordinary(text)
            assert c.decode(ids) == text.encode()


def test_encode_decode_and_round_trip(spark):
    docs = X.documents(spark)
    encoded = B.bpe_encode(docs)
    decoded = Counter(bytes(r.data).decode() for r in B.bpe_decode(encoded).collect())
    assert decoded == Counter(r[1] or "" for r in X.rows())
    c = B.codec()
    want = Counter()
    for r in X.rows():
        ids = c.encoding.encode_ordinary(r[1] or "")
        want[(r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in B.bpe_round_trip(docs).collect()) == want
    assert B.bpe_round_trip(X.empty(spark)).count() == 0


def test_chunk_memory_equals_the_library():
    plain = Tokenizer.from_file(public_tokenizers.path(T.VOCABULARY))
    enc = T.WordEncoder(public_tokenizers.path(T.VOCABULARY), capacity=200)
    for k in range(40):
        texts = [noise(1000 + 10 * k + i, 80) for i in range(10)]
        flat, at = enc.encode_many(pa.array(texts, pa.string()))
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files(spark):
    folder = shared_dir(spark, "files")
    more = [(-(1 << 63), "the smallest id", None, None, 0), (5, "a <|endoftext|> b", None, None, 0), (5, "a <|ENDOFTEXT|> b", None, None, 0)]
    more += [(7, X.prose(77, 400), None, None, 0)] * 30  # rows of one id, dealt to several files
    docs = X.documents(spark).select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(more, X.SCHEMA))
    manifest = T.write_token_files(docs, folder, end_id=2, file_bytes=20_000)
    assert manifest.count() > 1
    rows = T.read_token_files(manifest, folder).collect()
    plain = Tokenizer.from_file(public_tokenizers.path(T.VOCABULARY))
    ids = {t: plain.encode(t, add_special_tokens=False).ids + [2] for t in {r[1] or "" for r in X.rows() + more}}
    want = Counter((r[0], len(ids[r[1] or ""]), zlib.crc32(np.array(ids[r[1] or ""], "<u4").tobytes())) for r in X.rows() + more)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in ordered] == list(np.cumsum([0] + [r.n_tokens for r in ordered])[:-1])
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in ordered]
    assert keys == sorted(keys)
    assert max(Counter(x for m in manifest.collect() for x in set(T.TokenFile(f"{folder}/tokens-{m.file:06d}.tkz").doc_ids.tolist())).values()) > 1
    f = T.TokenFile(f"{folder}/tokens-{manifest.first().file:06d}.tkz")
    last = len(f.doc_ids) - 1
    (i, got), = f.frames([last])
    assert i == last and len(got) == f.counts[last] and got[-1] == 2
    f.crcs[last] += 1
    with pytest.raises(ValueError):
        list(f.frames([last]))
    f.close()
    none = T.write_token_files(X.empty(spark), folder + "-none", end_id=2)
    assert T.read_token_files(none, folder + "-none").count() == 0


def test_fingerprint_estimates():
    base = X.prose(3, 400).split()
    other = base[:300] + X.prose(4, 100).split()
    a, b, c, none, none2 = P.fingerprints([" ".join(base), " ".join(other), " ".join(base).upper(), "", " \n"])
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, other)]
    truth = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs(a.likeness(b) - truth) < 0.15 and a.likeness(c) == 1.0 and str(a) == str(c)
    assert str(none) == "" and none.likeness(none2) == 1.0 and none.likeness(a) == 0.0
    assert P.pack(np.array([1, 2, 3, 0], np.uint8), 2) == bytes([0b01101100])
    short = P.fingerprints(["one two", "one two", "two one"])
    assert short[0].likeness(short[1]) == 1.0 and short[0].likeness(short[2]) < 0.3


def brute_codes(text, bins=P.BINS, bits=P.BITS):
    """Bins of the shingle hashes, their minima, densification and low bits, one by one."""
    h, _ = K.shingles(pa.array([text], pa.string()))
    least = {}
    for x in h.tolist():
        j, rest = x >> (64 - bins.bit_length() + 1), x & ((1 << (64 - bins.bit_length() + 1)) - 1)
        least[j] = min(least.get(j, rest), rest)
    if not least:
        return None
    out = []
    for j in range(bins):
        k, attempt = j, 0
        while k not in least:
            attempt += 1
            k = K.mix_int((j * 0x9E3779B97F4A7C15 + attempt) & ((1 << 64) - 1)) % bins
        out.append(least[k] & ((1 << bits) - 1))
    return out


def test_fingerprints_against_brute_force():
    texts = [X.prose(i, n) for i, n in enumerate((1, 4, 5, 6, 20, 100, 900))] + ["", " \n", "é 漢字 x y z w"] + [r[1] or "" for r in X.rows()]
    for t, f in zip(texts, P.fingerprints(texts)):
        want = brute_codes(t)
        assert (None if f.codes is None else f.codes.tolist()) == want
        assert str(f) == ("" if want is None else base64.b64encode(bytes(want)).decode())
    some = [f for f in P.fingerprints(texts) if f.codes is not None]
    for a, b in zip(some, some[1:]):
        same = sum(x == y for x, y in zip(a.codes.tolist(), b.codes.tolist())) / P.BINS
        assert abs(a.likeness(b) - min(1, max(0, (same - 1 / 256) / (1 - 1 / 256)))) < 1e-12


def test_ranges_split_rows_of_one_id():
    r = np.random.default_rng(2)
    rows = sorted({(int(a), int(b)) for a, b in zip(r.integers(0, 4, 300), r.integers(-(1 << 62), 1 << 62, 300))})
    cuts = sorted(rows[i] for i in r.choice(len(rows), 9, replace=False))
    ranges = P.Ranges(np.array([a for a, _ in cuts]), np.array([b for _, b in cuts]))
    got = ranges.of(np.array([a for a, _ in rows]), np.array([b for _, b in rows]))
    assert got.tolist() == [sum(c < x for c in cuts) for x in rows]


def test_edits_follow_the_order_of_ids(spark):
    rows = [(i * 7, X.prose(i, 5 + 9 * i), "en", "s", 0) for i in range(30)] + [(3, None, None, None, 0), (4, "", None, None, 0)]
    want = {}
    ordered = sorted(rows)
    for r, n in zip(ordered, [*ordered[1:], ordered[0]]):
        t, following = r[1] or "", n[1] or ""
        k = len(t) // 4
        want[r[0]] = (len(t), hashlib.sha256((t[: len(t) - k] + following[:k]).encode()).hexdigest())
    for ranges in (1, 4, 50):
        got = P.fingerprint_edits(spark.createDataFrame(rows, X.SCHEMA).repartition(4), ranges).collect()
        assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want
    assert len(P.fingerprint_edits(X.documents(spark), 3).collect()) == len(X.rows())
    assert P.fingerprint_edits(X.empty(spark), 3).count() == 0
