import hashlib
import re
from collections import Counter

from pagewright.llm import near_dedup as N
from pagewright.llm import suffix_dedup as S
from pagewright.llm._components import components

from . import fixtures as X

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows, percent):
    sets = [shingle_set(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min(v, key=lambda d: (d is not None, d or 0)) for k, v in groups.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))]


def test_near_duplicates_against_brute_force(spark):
    for percent in (80, 85):
        got = N.near_duplicates(X.documents(spark), percent).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component) for r in got) == Counter(brute_components(X.rows(), percent))
    assert N.near_duplicates(X.empty(spark)).count() == 0


def test_near_duplicates_of_one_family(spark):
    """Many copies of one text, each edited elsewhere: links of all strengths."""
    base = X.prose(1, 140).split()
    rows = []
    for i in range(90):
        w = list(base)
        for k in range(i % 7):
            w[(i * 13 + k * 29) % len(w)] = f"edit{i}_{k}"
        rows.append((i, " ".join(w), "en", "s", 0))
    got = N.near_duplicates(spark.createDataFrame(rows, X.SCHEMA), 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component) for r in got) == sorted(brute_components(rows, 85))


def test_keep_one_keeps_columns_and_wordless_rows(spark):
    docs = X.documents(spark)
    out = N.keep_one(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sum(1 for r in rows if not (r.text or "").split()) == sum(1 for r in X.rows() if not (r[1] or "").split())
    assert len({r.text for r in rows if (r.text or "").split()}) == sum(1 for r in rows if (r.text or "").split())
    assert X.rows()[0][1] in {r.text for r in rows}
    assert N.keep_one(X.empty(spark)).count() == 0


def brute_removal(rows, length):
    data = [(r[1] or "").encode() for r in rows]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_suffix_dedup_against_brute_force(spark):
    for length in (60, 400):
        got = S.repeated_spans(X.documents(spark), length, texts_too=True).collect()
        assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter(brute_removal(X.rows(), length))
        assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got if r.n_bytes == len(r.kept_text.encode()) + r.n_removed)
        assert sorted(r.kept_text for r in got if not r.n_removed) == sorted(x[1] or "" for x, y in zip(X.rows(), brute_removal(X.rows(), length)) if not y[1])
    assert S.repeated_spans(X.empty(spark)).count() == 0


def test_remove_repeats_rewrites_texts(spark):
    docs = X.documents(spark)
    out = S.remove_repeats(docs, 200)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    rows = out.collect()
    assert len(rows) == len(X.rows())
    assert not any(X.PASSAGE in (r.text or "") for r in rows)
    assert X.rows()[6][1] in {r.text for r in rows}
    assert all(r.text is None or r.n_chars in (len(r.text), 5) for r in rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_of_equal_short_hashes_and_null_ids_stay_apart(spark):
    """The texts have equal 32-bit Spark hashes, and all rows the null id."""
    from pyspark.sql import functions as F

    made = spark.range(200_000).select(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" common words that follow here")).alias("t"))
    pair = made.groupBy(F.hash("t").alias("h")).agg(F.collect_list("t").alias("ts")).where(F.size("ts") > 1).first().ts[:2]
    passage = X.prose(33, 90)
    rows = [(None, t + " " + passage * k, None, None, 0) for k in (0, 1) for t in pair]
    docs = spark.createDataFrame([r for r in rows for _ in range(2)], X.SCHEMA)
    same = [r for r in rows for _ in range(2)]
    got = S.repeated_spans(docs, 60).collect()
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter(brute_removal(same, 60))
    assert Counter((r.doc_id, r.n_shingles, r.component) for r in N.near_duplicates(docs, 85).collect()) == Counter(brute_components(same, 85))
    one = [r.text for r in N.keep_one(docs, 85).collect()]
    assert len(one) == len(set(one)) and set(one) <= {r[1] for r in rows}


def test_ranks_of_each_round_against_sorted_strings(spark):
    """Two positions have equal ranks just when their 2 and 4 units of bytes are equal, and
    unique ones have none."""
    length = 60
    unit = S.unit_of(length)
    texts = [X.prose(i, 60) + " " + X.PASSAGE[: 300 + 7 * i] + X.prose(20 + i, 20) for i in range(6)]
    data = [t.encode() for t in texts]
    size = [len(d) - length + 1 for d in data]
    rows = [(i, at, d[at : at + unit], d[at + unit : at + 2 * unit], at < size[i]) for i, d in enumerate(data) for at in range(len(d) - 2 * unit + 1)]
    names = {x: k for k, x in enumerate(sorted({x for r in rows for x in r[2:4]}))}
    positions = spark.createDataFrame([(r[0], r[1], names[r[2]], names[r[3]], r[4]) for r in rows], "rid long, at int, a long, b long, grid boolean")
    two = {(r.rid, r.at): r.rank for r in S.rerank(positions).collect()}
    count = Counter(d[at : at + 2 * unit] for d in data for at in range(len(d) - 2 * unit + 1))
    want = {(i, at): d[at : at + 2 * unit] for i, d in enumerate(data) for at in range(len(d) - 2 * unit + 1) if count[d[at : at + 2 * unit]] > 1}
    assert set(two) == set(want) and len(set(zip(two.values(), (want[k] for k in two)))) == len(set(two.values())) == len(set(want.values()))
    four = {(r.rid, r.at): r.rank for r in S.doubled(positions, length).collect()}
    count = Counter(d[at : at + 4 * unit] for i, d in enumerate(data) for at in range(size[i]))
    want = {(i, at): d[at : at + 4 * unit] for i, d in enumerate(data) for at in range(size[i]) if count[d[at : at + 4 * unit]] > 1}
    assert set(four) == set(want) and len(set(zip(four.values(), (want[k] for k in four)))) == len(set(four.values())) == len(set(want.values()))


def test_suffix_dedup_of_periods_and_stretches(spark):
    """Runs, periods, and repeats that cross the stretches of a long text."""
    base = X.prose(8, 300)
    texts = ["ab" * 300, "x" * 130 + base[:500] + "x" * 70, base[100:420] + "y" + base[100:420], base, "abc" * 41 + base[600:700] * 3, base[650:900]]
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, X.SCHEMA)
    for stretch in (S.STRETCH, 97):
        for length in (23, 60, 111):
            got = S.repeated_spans(docs, length, stretch).collect()
            assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter(brute_removal(rows, length)), (stretch, length)


def test_crowded_regions_lose_no_link(spark, monkeypatch):
    """A family whose members all share their signature prefixes, at forced depths and sizes."""
    base = X.prose(1, 150).split()
    rows = []
    for i in range(120):
        w = list(base)
        for k in range(i % 9):
            w[(i * 13 + k * 29) % len(w)] = f"edit{i}_{k}"
        rows.append((i, " ".join(w), "en", "s", 0))
    rows += [(200 + i, X.prose(300 + i, 40), "en", "s", 0) for i in range(20)]
    want = sorted(brute_components(rows, 85))
    for crowd, block in ((8, 16), (30, 512), (1024, 10)):
        monkeypatch.setattr(N, "CROWD", crowd)
        monkeypatch.setattr(N, "BLOCK", block)
        got = N.near_duplicates(spark.createDataFrame(rows, X.SCHEMA), 85).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component) for r in got) == want, (crowd, block)
