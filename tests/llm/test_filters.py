import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagewright.llm import _kernels as K
from pagewright.llm import decontaminate as D
from pagewright.llm import quality as Q
from pagewright.llm import sharding as H
from pagewright.llm import toxicity as T
from pagewright.llm import url_filter as U

from . import fixtures as X


def labelled(spark, make):
    r = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(240):
        y = int(r.random() < 0.4)
        docs.append((i, make(i, y), "en", "s", 0))
        labels.append((i, y, y))
    return spark.createDataFrame(docs, X.SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_held_out_accuracy(spark):
    docs, labels = labelled(spark, lambda i, y: " ".join(w if y else w + "###" for w in X.prose(i, 60).split()))
    learn = labels.where(~Q.held_out("doc_id", 4, 2))
    got = {r.doc_id: r.predicted for r in Q.quality_classifier(docs, learn).collect()}
    test = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([got[r.doc_id] == r.quality for r in test]) > 0.95
    out = Q.quality_classifier(X.documents(spark), learn).collect()
    assert len(out) == len(X.rows()) and all(0 <= r.score <= 1 for r in out)
    assert Q.quality_classifier(X.documents(spark), labels.limit(0)).count() == len(X.rows())
    assert Q.quality_classifier(X.empty(spark), learn).count() == 0


def test_subword_features_are_whole_text():
    a = pa.array(["abcd", "", "abcd efg"])
    n = np.zeros(3, int)
    for _, begin, end in Q.feature_blocks(a, 16):
        n += end - begin
    assert n.tolist() == [1 + 2 + 1, 0, 2 + 6 + 5]


def test_toxicity_held_out(spark):
    bad = ["vilewordone", "vilewordtwo", "nastything"]
    docs, labels = labelled(spark, lambda i, y: X.prose(i, 80) + (" " + bad[i % 3] + " word " + bad[(i + 1) % 3] + "." if y else ""))
    learn = ~Q.held_out("doc_id", 3, 1)
    got = {r.doc_id: r.predicted for r in T.toxicity(docs, labels.where(learn), usable=learn).collect()}
    test = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([got[r.doc_id] == r.toxic for r in test]) > 0.95
    out = T.reject_toxic(X.documents(spark), labels.limit(0))
    assert out.count() == len(X.rows()) and out.columns == X.documents(spark).columns
    assert T.toxicity(X.empty(spark), labels).count() == 0


LONG = X.prose(4321, 30_000)


def test_quality_scores_against_features_one_by_one():
    r = np.random.default_rng(0)
    model = Q.QualityModel(r.normal(0, 3, 1 << 16).astype(np.float32), 0.25, 16)
    texts = ["", " \n", "a", "ab cd", "é漢字 x", "Word word WORD", X.prose(5, 40), LONG] + [r[1] or "" for r in X.rows()][:8]
    got = model.score(pa.array(texts))
    for t, score in zip(texts, got):
        ids = [int(K.span_hash(K.prefix_hash(np.frombuffer(w.encode(), np.uint8)), np.array([0]), np.array([len(w.encode())]))[0]) >> 48 for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
        for k in Q.ORDERS:
            for i in range(len(t) - k + 1):
                g = k
                for j in range(k):
                    g = (g ^ ord(t[i + j])) * int(Q._MULT[j]) & 0xFFFFFFFF
                g = (g ^ g >> 15) * int(Q._MULT[4]) & 0xFFFFFFFF
                ids.append(g >> 16)
        z = float(np.sum(model.weights[ids], dtype=np.float64)) / max(len(ids), 1) + 0.25
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-6


def test_toxicity_scores_against_features_one_by_one():
    r = np.random.default_rng(1)
    slot = np.zeros(1 << T.BITS, np.int32)
    slot[r.choice(1 << T.BITS, 1 << 16, replace=False)] = np.arange(1, (1 << 16) + 1)
    model = T.ToxicityModel(slot, np.concatenate(([0.0], r.normal(0, 1, 1 << 16))), -0.5)
    texts = ["", "12 34", "word", "Wordly wordly! words", "éléphant été", X.prose(6, 60), LONG]
    hash_of = lambda b: int(K.span_hash(K.prefix_hash(np.frombuffer(b, np.uint8), lower=True), np.array([0]), np.array([len(b)]))[0])
    for t, score in zip(texts, model.score(pa.array(texts))):
        words = re.findall(rb"[A-Za-z\x80-\xff]+", t.encode())
        seen = Counter()
        for w in words:
            seen[hash_of(w) >> (64 - T.BITS)] += 1
            for k in T.PREFIXES:
                if len(w) > k:
                    seen[(hash_of(w[:k]) ^ (0xABCDEF0123456789 + k)) >> (64 - T.BITS)] += 1
        slots = Counter()
        for b, n in seen.items():
            slots[int(slot[b])] += n
        z = -0.5 + sum(model.weights[s] * 4.0 * n / (n + 1.0 + len(words) / 250.0) for s, n in slots.items() if s)
        assert abs(score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9


def test_classifiers_take_very_long_texts(spark):
    docs, labels = labelled(spark, lambda i, y: X.prose(i, 30) + (" vileword" * 3 if y else ""))
    more = docs.unionByName(spark.createDataFrame([(9000, LONG, "en", "s", 0), (9001, LONG + " vileword" * 4000, "en", "s", 0)], X.SCHEMA))
    more_labels = labels.unionByName(spark.createDataFrame([(9000, 0, 0), (9001, 1, 1)], "doc_id long, quality int, toxic int"))  # too long to be learned from
    for out in (Q.quality_classifier(more, more_labels), T.toxicity(more, more_labels)):
        got = {r.doc_id: r.score for r in out.where("doc_id >= 9000").collect()}
        assert len(got) == 2 and got[9001] > got[9000] and all(0 <= s <= 1 for s in got.values())


def test_risk_is_non_negative_and_clean_text_scores_low():
    model = T.fit([X.prose(i, 30) + " curse" for i in range(40)], [X.prose(100 + i, 30) + (" curse" if i % 10 == 0 else "") for i in range(200)], 0.1)
    s = model.score(pa.array([X.prose(900, 30) + " curse", X.prose(901, 30), ""]))
    assert s[0] > 0.7 > 0.3 > s[1] and s[2] < 0.3


def items():
    return [(1, X.PASSAGE), (2, X.prose(800, 30)), (3, "Only four words here"), (4, ""), (5, None), (6, X.prose(801, 12) + ". The answer is " + X.prose(802, 6) + ".")]


def brute_hits(texts):
    words = lambda t: re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", (t or "").lower())
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    out = []
    for t in texts:
        w = words(t)
        hit = []
        for i, text in items():
            v = words(text)
            if not v:
                continue
            question, answer = (words(x) for x in D.split_answer(text))
            question = v if len(v) < 5 else question
            if len(question) < 5:
                ok = any(w[k : k + len(question)] == question for k in range(len(w) + 1))
            else:
                ok = len(grams(question) & grams(w)) >= 0.8 * len(grams(question))
            if ok and len(set(answer) & set(w)) >= 0.5 * len(set(answer)):
                hit.append(i)
        out.append(hit)
    return out


def test_decontamination_against_brute_force(spark):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    quoted = items()[5][1]
    question, answer = D.split_answer(quoted)
    assert brute_hits([question, answer, question + " " + answer]) == [[], [], [6]]
    planted = [(490 + k, X.prose(640 + k, 50) + " " + t + " " + X.prose(740 + k, 50), "en", "s", 0) for k, t in enumerate((question, answer, answer + " and " + question, quoted[: len(quoted) // 2]))]
    planted += [(500 + k, X.prose(600 + k, 40 * k) + " " + (t or "").upper() + " " + X.prose(700 + k, 90), "en", "s", 0) for k, (_, t) in enumerate(items())]
    docs = X.documents(spark).select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(planted, X.SCHEMA))
    texts = [r[1] for r in X.rows()] + [r[1] for r in planted]
    want = Counter(tuple(h) for h in brute_hits(texts))
    assert Counter(tuple(r["items"]) for r in D.decontaminate(docs, bench).collect()) == want
    kept = D.drop_contaminated(docs, bench)
    assert kept.count() == want[()] and kept.columns == docs.columns
    assert D.decontaminate(docs, bench.limit(0)).where(F.size("items") > 0).count() == 0
    assert D.decontaminate(X.empty(spark), bench).count() == 0


def test_wand_finds_all_above_the_threshold():
    texts = [X.prose(i, 12 + i % 9) for i in range(60)]
    index = D.ItemIndex(list(range(60)), texts)
    for q in range(20):
        hashes, _ = D._hashes(pa.array([texts[q] + " " + texts[q + 20] + " " + X.prose(5000 + q, 30)]))
        terms = np.unique(index.terms(hashes))
        terms = terms[terms >= 0]
        score = np.zeros(60)
        for t in terms:
            a, b = index.first[t], index.first[t + 1]
            score[index.items[a:b]] += index.impacts[a:b]
        for limit in (0.2, 0.5, 0.9):
            got = dict(index.search(terms, limit))
            assert set(got) == set(np.flatnonzero(score >= limit - 1e-9))
            assert all(abs(got[i] - score[i]) < 1e-9 for i in got)


URLS = [
    ("http://Sub.Example.NET/en/1?x", "sub.example.net", "/en/1", "example.net/en/", "allow"), ("https://example.net/EN/1", "example.net", "/EN/1", "net/", "block"), ("ftp://a.net", "a.net", "", None, None),
    ("http://notexample.com/de/", "notexample.com", "/de/", None, None), ("http://example.com/de/x#y", "example.com", "/de/x", "example.com/de/", "block"), ("x://b.org/fr/#z", "b.org", "/fr/", "org/fr/", "allow"),
    (None, "", "", None, None), ("no scheme/net/", "", "", None, None), ("", "", "", None, None), ("a://É.net/?q://z", "É.net", "/", "net/", "block"), ("a://?x", "", "", None, None),
]


def test_url_rules_and_model(spark):
    pages = [(i, u[0], "t") for i, u in enumerate(URLS)] + [(100 + i, f"http://good{i}.org/fr/a{i}" if i % 2 else f"http://spam-casino{i}.net/win{i}", "t") for i in range(60)] + [(500, "http://good7.org/en/a9", "t"), (501, "http://spam-casino9.com/win3", "t")]
    got = {r.page_id: r for r in U.filter_urls(spark.createDataFrame(pages, "page_id long, url string, rule string")).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert got[500].verdict == "allow" and got[501].verdict == "block"
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    alone = U.filter_urls(spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")).first()
    assert alone.verdict == "allow" and alone.rule is None


def test_url_scores_against_plain_python(spark):
    urls = [(f"http://good{i}.org/fr/", True) for i in range(9)] + [(f"http://bad{i}.net/x", False) for i in range(9)]
    df = spark.createDataFrame(urls, "url string, accepted boolean")
    got = {r.url: r.score for r in U.score_urls(df, U.model_row(U.log_ratios(U.gram_counts(df)))).collect()}
    counts = {True: Counter(), False: Counter()}
    for u, y in urls:
        t = U._START * U.ORDER + u + U._END
        for i in range(U.ORDER, len(t) + 1):
            for k in range(1, U.ORDER + 2):
                if i >= k:
                    counts[y][t[i - k : i]] += 1
    total = {y: sum(c for g, c in counts[y].items() if len(g) == 1 and g != U._START) for y in counts}
    for u, _ in urls:
        t = U._START * U.ORDER + u + U._END
        s = 0.0
        for i in range(U.ORDER, len(t)):
            p = {True: 1 / 256, False: 1 / 256}
            for k in range(U.ORDER + 1):
                context = t[i - k : i]
                if k and not counts[True][context] and not counts[False][context]:
                    break
                for y in p:
                    c = counts[y][context] if k else total[y]
                    p[y] = (counts[y][t[i - k : i + 1]] + U.STRENGTH * p[y]) / (c + U.STRENGTH)
            s += np.log(p[True]) - np.log(p[False])
        assert abs(got[u] - s / (len(t) - U.ORDER)) < 1e-3  # hashed cells may be shared


def test_url_scores_of_many_grams_are_exact(spark):
    r = np.random.default_rng(8)
    text = lambda: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 50))
    urls = [(text(), i % 2 == 0) for i in range(1500)] + [(text(), None) for _ in range(100)] + [(None, None), ("", None)]
    df = spark.createDataFrame(urls, "url string, accepted boolean")
    got = {x.url: x.score for x in U.score_urls(df, U.model_row(U.log_ratios(U.gram_counts(df.where("accepted is not null"))))).collect()}
    counts = {True: Counter(), False: Counter()}
    for u, y in urls[:1500]:
        t = U._START * U.ORDER + u + U._END
        for i in range(U.ORDER, len(t) + 1):
            counts[y].update(t[i - k : i] for k in range(1, U.ORDER + 2) if i >= k)
    assert len(set(counts[True]) | set(counts[False])) > 1 << 16
    total = {y: sum(c for g, c in counts[y].items() if len(g) == 1 and g != U._START) for y in counts}
    for u, _ in urls:
        t, s = U._START * U.ORDER + (u or "") + U._END, 0.0
        for i in range(U.ORDER, len(t)):
            p = {True: 1 / 256, False: 1 / 256}
            for k in range(U.ORDER + 1):
                context = t[i - k : i]
                for y in p:
                    p[y] = (counts[y][t[i - k : i + 1]] + U.STRENGTH * p[y]) / ((counts[y][context] if k else total[y]) + U.STRENGTH)
            s += np.log(p[True]) - np.log(p[False])
        assert abs(got[u] - s / (len(t) - U.ORDER)) < 1e-8


def test_hilbert_curve_is_continuous(spark):
    for bits, n in ((2, 2), (3, 3), (4, 3)):
        df = spark.range(1 << (bits * n))
        axes = [F.shiftright("id", bits * i).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(n)]
        rows = df.select(*[a.alias(f"a{i}") for i, a in enumerate(axes)]).withColumn("h", H.hilbert_index([F.col(f"a{i}") for i in range(n)], bits)).orderBy("h").collect()
        assert [r.h for r in rows] == list(range(1 << (bits * n)))
        assert all(sum(abs(x - y) for x, y in zip(p[:n], q[:n])) == 1 for p, q in zip(rows, rows[1:]))


def test_shards(spark):
    out = H.hilbert_shards(X.documents(spark), 8).collect()
    rows = X.rows()
    assert len(out) == len(rows)
    counts = Counter(r.shard for r in out)
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(8)) <= 1
    for s in counts:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    assert H.hilbert_shards(X.documents(spark).where("doc_id in (0, 3, 6)"), 8).count() == 3 and H.hilbert_shards(X.empty(spark), 8).count() == 0


def brute_shards(rows, n_shards, bits):
    """The law and the order of cells from sorted values, row by row."""
    n = len(rows)
    steps = {}
    for k, values in enumerate(([r[2] for r in rows], [r[3] for r in rows], [len((r[1] or "").encode()) + 1 for r in rows])):
        known = sorted(v for v in values if v is not None)
        top = {}
        for v in set(known):
            last = max(i for i, x in enumerate(known) if x == v)
            step = last * (1 << bits) // len(known)
            top[step] = max(top.get(step, v), v)
        bounds = [top[s] for s in sorted(top)][:-1]
        steps[k] = [0 if v is None else sum(v > b for b in bounds) for v in values]
    group = {}
    for i, r in enumerate(rows):
        group.setdefault(r[1] or "", []).append(i)
    cell = [None] * n
    for members in group.values():
        least = tuple(min(steps[k][i] for i in members) for k in range(3))
        for i in members:
            cell[i] = least
    return cell


def test_cells_and_ranks_against_brute_force(spark):
    rows = X.rows() + [(900 + i, X.prose(900 + i, 5 + 7 * i), "xx"[: 1 + i % 2] + "yz"[i % 2], f"https://host{i % 13}.example/a", 0) for i in range(60)]
    out = H.hilbert_shards(spark.createDataFrame(rows, X.SCHEMA).repartition(3), 8).collect()
    cells = brute_shards(rows, 8, H.BITS)
    assert len({c[1] for c in cells}) > 10  # sources that share a long beginning
    point = spark.createDataFrame([(*c,) for c in sorted(set(cells))], "a int, b int, c int")
    index = {(r.a, r.b, r.c): r.h for r in point.withColumn("h", H.hilbert_index([F.col(k) for k in "abc"], H.BITS)).collect()}
    want = Counter((r[0], zlib.crc32((r[1] or "").encode()), index[c]) for r, c in zip(rows, cells))
    assert Counter((r.doc_id, r.text_crc32, r.cell) for r in out) == want
    ordered = sorted(out, key=lambda r: (r.shard, r.slot))
    assert [r.cell for r in ordered] == sorted(r.cell for r in out)
    n = len(rows)
    assert [(r.shard, r.slot) for r in ordered] == [(i * 8 // n, i - -(-(i * 8 // n) * n // 8)) for i in range(n)]
    places = {}
    for i, r in enumerate(ordered):
        places.setdefault((r.text_crc32, r["size"]), []).append(i)
    assert all(p == list(range(p[0], p[0] + len(p))) for p in places.values())  # equal texts lie together


def test_crowded_cells_are_salted(spark, monkeypatch):
    monkeypatch.setattr(H, "CROWD", 10)
    docs = spark.createDataFrame([(i, "same text", "en", "s", 9) for i in range(101)], X.SCHEMA)
    out = H.hilbert_shards(docs, 8).collect()
    assert sorted(Counter(r.shard for r in out).values()) == [12, 12, 12, 13, 13, 13, 13, 13]
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out))) for s in range(8))
