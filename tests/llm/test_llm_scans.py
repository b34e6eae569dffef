"""Periodic runs, license scans and resampling toward a target against brute force, with nulls, blanks, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import licenses, periods, queries, session, targeting, text

FOLDER = "/root/testdata/sf0.001"
WORD, PLAIN = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, n_words long, start long, score string, _w string, runs string, label string"
NONE = hashlib.sha256(b"").hexdigest()


def brute(w, repeats=4, least=6):
    out = set()
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, repeats * q) and all(any(w[k] != w[k + p] for k in range(s, i + q - p)) for p in range(1, q)):
                out.add((s, q, i + q - s))
            i = max(i, s + 1)
    return sorted(out)


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_small_alphabets(seed):
    rng = random.Random(seed)
    for _ in range(250):
        k, w = rng.choice([1, 2, 2, 3, 5]), []
        while len(w) < rng.randint(0, 80):
            w += [rng.randint(-k, k) for _ in range(rng.randint(1, 9))] * rng.randint(1, 7)
        assert periods.runs(w) == brute(w), w


def test_runs_of_hard_words():
    thue, fib = [0], [[0], [0, 1]]
    for _ in range(13):
        fib.append(fib[-1] + fib[-2])
    while len(thue) < 512:
        thue += [1 - x for x in thue]
    for w in (thue, fib[14], thue[:100] * 5, [7] * 300, fib[10] * 6, list(range(90)) * 4 + list(range(60)), [1, 2] * 50 + [1, 1] + [2, 1] * 50):
        assert periods.runs(w) == brute(w)
    assert periods.runs([3] * 100_000) == [(0, 1, 100_000)]
    rng = random.Random(3)
    u = [rng.getrandbits(60) for _ in range(20_000)]
    assert periods.runs([*u * 4, *u[:5000]]) == [(0, 20_000, 85_000)]
    with pytest.raises(ValueError, match="repeats"):
        periods.runs([1] * 9, repeats=3)


@pytest.mark.parametrize("seed", range(4))
def test_extension_both_ways(seed):
    rng = random.Random(seed)
    w = [rng.randint(0, 1) for _ in range(7)] * 30 + [rng.randint(0, 1) for _ in range(60)]
    e = periods.Extension(w)
    for _ in range(400):
        i, j = sorted(rng.sample(range(len(w)), 2))
        k = 0
        while j + k < len(w) and w[i + k] == w[j + k]:
            k += 1
        m = 0
        while m < i and w[i - 1 - m] == w[j - 1 - m]:
            m += 1
        assert (e.right(i, j), e.left(i, j)) == (k, m)


def test_longest_lyndon_words():
    rng = random.Random(2)
    for _ in range(60):
        w = [rng.randint(0, 2) for _ in range(rng.randint(1, 30))]
        for sign in (1, -1):
            v = [sign * x for x in w]
            want = [max(j for j in range(i + 1, len(v) + 1) if all(v[i:j] < v[k:j] for k in range(i + 1, j))) for i in range(len(v))]
            assert periods.next_smaller(w, sign, periods.Extension(w)).tolist() == want


def test_words_that_hash_alike_are_told_apart():
    words = ["aa", "bb", "aa", "cc", "aa", "bb", "aa", "bb"] * 6
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    _, rows, starts, ends = text.words(data, np.array([0, len(data)]), lower=text.AS_IS)
    flat, first, last = text.joined(data, starts, ends)
    assert periods._verified(np.ones(len(rows), np.uint64), flat, first, last, 4, 6) == brute(words)


def messy():
    rng = random.Random(4)
    rows = [[i, " ".join(rng.choice(["the", "The", "of", "stone", "é", "wx.y", "a-b"]) for _ in range(rng.randint(0, 60)))] for i in range(70)]
    rows += [[70, None], [71, ""], [72, " \t\r\n\x0b"], [73, "again \x00 " * 9], [None, "one two " * 12], [None, None], [5, rows[5][1]], [74, "\U0001f642\tx\n" * 40 + "  end"], [75, ("lorem " * 3 + "ipsum\n") * 30_000], [-8, "q " * 5], [76, "q " * 6]]
    return [(*r, "l", 7, 8, "s", "w", "r", "lab") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    session.workers_find_package(spark)
    return spark.createDataFrame(messy(), SCHEMA).repartition(3).persist()


def edited(doc_id, t):
    w = WORD.findall(t or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def digests(doc_id, t):
    w = edited(doc_id, t)
    found = brute(w) if len(w) < 2000 else [(0, 4, len(w))]
    gone = {k for s, q, n in found for k in range(s + q, s + n)}
    top = min(found, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]), default=None)
    told = "".join(f"{s},{n},{q}\n" for s, q, n in found)
    own = (top[0], top[2], top[1], 1000 * top[2] // top[1]) if top else (None,) * 4
    return doc_id, len(found), *own, *[hashlib.sha256(x.encode()).hexdigest() for x in (told, " ".join(x for k, x in enumerate(w) if k not in gone))]


def by_text(rows):
    return sorted(map(str, map(tuple, rows)))


def test_runs_of_texts(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = periods.periodic_runs(docs)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    assert by_text(periods.op11_periodic_runs(spark, str(tmp_path)).collect()) == by_text(digests(*r[:2]) for r in messy())
    assert [r.collapsed for r in got.where("doc_id = 76").collect()] == ["q"]
    assert not periods.periodic_runs(docs.limit(0)).collect()


def test_runs_of_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    got = periods.op11_periodic_runs(spark, FOLDER).collect()
    w = {i: edited(i, t) for i, t in docs.items()}
    short = {i for i in docs if len(w[i]) < 500}
    assert len(got) == len(docs) and len(short) > 100 and sum(r.n_runs > 0 for r in got) > 10
    assert by_text(r for r in got if r.doc_id in short) == by_text(digests(i, docs[i]) for i in short)


def places(t, phrases=licenses.PHRASES):
    w = PLAIN.findall((t or "").translate(LOW))
    return w, sorted((i, label, len(p.split())) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


def license_texts():
    mit, gpl = (next(t for label, t in licenses.TEMPLATES if label == x) for x in ("mit-text", "gpl-text"))
    noise = "zz yy xx ww vv uu tt ss " * 4
    w = mit.split()
    return {
        0: mit, 1: noise + mit.upper() + noise + mit, 2: " ".join(w[:30] + ["indeed"] * 4 + w[30:60] + w[64:]), 3: " ".join(w[:20]), 4: noise + gpl + " Apache  License,\nMIT license CC BY cc by",
        5: "the GNU General Public License, version 3", 6: "Licensed under the GNU General Public License, version 3!", 7: "Licensed under CC BY-NC 4.0.", 8: "All rights reserved", 9: None, 10: "", 11: " ,.; ", 12: "\x00mit\x00license gnu\x7fgeneral general public license",
        13: noise * 3000 + "mit license " * 500, 14: " ".join(reversed(w)), 15: "apache licenseé mit licenses",
    }


def test_license_scan(spark, tmp_path):
    session.workers_find_package(spark)
    rows = [(i, t, "l", 7, "p", "s") for i, t in license_texts().items()] + [(None, "MIT license", "l", 7, "p", "s"), (0, "x", "l", 7, "p", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, n_words long, phrases string, spans string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t in license_texts().items() if i}
    for r in got:
        if r.doc_id in texts:
            w, want = places(texts[r.doc_id])
            assert r.n_words == len(w) and [(h.start, h.label, h.length) for h in r.phrases] == want
    spans = {r.doc_id: [(s.label, s.start, s.end) for s in r.spans] for r in got if r.doc_id is not None and r.n_words > 1}
    n = len(licenses.split(license_texts()[0]))
    assert spans[0] == [("mit-text", 0, n)] and spans[1] == [("mit-text", 32, 32 + n), ("mit-text", 64 + n, 64 + 2 * n)]
    assert [x[0] for x in spans[2]] == ["mit-text"] and spans[2][0][1:] == (0, n) and not spans[3] and not spans[5] and not spans[14]
    assert [x[0] for x in spans[4]] == ["gpl-text"] and [x[0] for x in spans[6]] == ["gpl-3.0"] and [x[0] for x in spans[7]] == ["cc-by-nc"] and [x[0] for x in spans[8]] == ["all-rights-reserved"]
    told = {r.doc_id: r for r in licenses.op12_license_scan(spark, str(tmp_path)).where("doc_id > 0").collect()}
    for i, t in texts.items():
        w, want = places(t)
        r = told[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(want), min((x[0] for x in want), default=None), max((x[0] for x in want), default=None))
        assert r.base_labels == ",".join(sorted({x[1] for x in want})) and r.labels == ",".join(sorted({x[1] for x in want} | {x[0] for x in spans.get(i, [])}))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert not licenses.scan(docs.limit(0)).collect()
    assert licenses.scan(docs, templates=[], phrases={}).where("size(spans) + size(phrases) > 0").count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_matches_are_all_longest_common_runs(seed):
    """Matches of LEAST letters or more that neither side extends, in every template, against all pairs of places; phrases too."""
    rng = random.Random(seed)
    line = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    templates = [("x", line(25)), ("y", line(18)), ("z", line(3)), ("x", line(9))]
    phrases = {"a b": "p", "b b a": "q", "c": "r"}
    matcher = licenses.Matcher(templates, phrases, 3)
    words = [w.decode() for w in matcher.words]
    for _ in range(40):
        doc = [rng.choice("abcd") if rng.random() < 0.9 else "d" for _ in range(40)]
        known = [(i, words.index(c)) for i, c in enumerate(doc) if c in words]
        hits, matches = matcher.stream([i for i, _ in known], [n for _, n in known])
        want = set()
        for k, (_, t) in enumerate(templates):
            t = t.split()
            for i in range(len(doc)):
                for j in range(len(t)):
                    n = 0
                    while i + n < len(doc) and j + n < len(t) and doc[i + n] == t[j + n]:
                        n += 1
                    if n >= 3 and not (i and j and doc[i - 1] == t[j - 1]):
                        want.add((k, i, i + n, j + n))
        assert sorted(matches) == sorted(want)
        assert sorted((s, label, n) for label, s, n in hits) == sorted((i, label, len(p.split())) for p, label in phrases.items() for i in range(40) if doc[i : i + len(p.split())] == p.split())


def test_chains_against_all_orders():
    rng = random.Random(9)
    for _ in range(60):
        found = sorted({(s := rng.randint(0, 60), s + n, t := rng.randint(0, 40), t + n) for n in rng.choices(range(3, 9), k=7)})
        best = 0
        for mask in range(1, 1 << len(found)):
            own = [m for i, m in enumerate(found) if mask >> i & 1]
            covered = own[0][1] - own[0][0]
            for a, b in zip(own, own[1:]):
                over = max(0, a[1] - b[0], a[3] - b[2])
                if not (a[0] < b[0] and a[1] < b[1] and a[2] < b[2] and a[3] < b[3] and b[0] - a[1] <= 12 and b[2] - a[3] <= 12 and over < b[1] - b[0]):
                    break
                covered += b[1] - b[0] - over
            else:
                best = max(best, covered)
        assert max(c for _, _, c in licenses.chains(found, 12)) == best


def test_crc32_of_spans():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(4000))
    starts = np.array([rng.randrange(3000) for _ in range(300)])
    ends = starts + np.array([rng.choice([0, 1, 2, 7, 63, 64, 65, 500]) for _ in range(300)])
    assert targeting.crc32(np.frombuffer(data, np.uint8), starts, ends).tolist() == [zlib.crc32(data[i:j]) for i, j in zip(starts.tolist(), ends.tolist())]


def drawn(rows, target, width, buckets, percent, least, seed):
    def own(t):
        w = PLAIN.findall((t or "").translate(LOW))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, width + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(own(x)[1])
    for x in target:
        t.update(own(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    out = []
    for i, x in rows:
        n, found = own(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    ranked = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[3], r[2]))
    for k, r in enumerate(ranked):
        r.append(k + 1 if k < len(ranked) * percent // 100 else None)
    return [tuple(r) if len(r) == 6 else (*r, None) for r in out]


@pytest.mark.parametrize("width,buckets,percent,least", [(1, 10_000, 10, 20), (2, 50, 60, 3), (3, 7, 100, 0)])
def test_target_resampling(spark, docs, width, buckets, percent, least):
    rows = [r[:2] for r in messy()]
    wanted = ["Stone the é", None, "", "of of a b wx y " * 20]
    target = spark.createDataFrame([(t, 1) for t in wanted], "text string, doc_id long")
    got = targeting.resample(docs, target, width, buckets, percent, least, 7)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert by_text(got.collect()) == by_text(drawn(rows, wanted, width, buckets, percent, least, 7))


def test_target_resampling_of_nothing(spark, docs):
    none = docs.limit(0)
    assert not targeting.resample(none, docs).collect()
    rows = [r[:2] for r in messy()]
    assert by_text(targeting.resample(docs, none).collect()) == by_text(drawn(rows, [], 1, 10_000, 10, 20, 2024))


def test_target_resampling_has_the_rows_of_its_sql(spark):
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    cur = con.execute(queries.oracle_sql()["op13_target_resampling"])
    names = [x[0] for x in cur.description]
    got = targeting.op13_target_resampling(spark, FOLDER).select(*[F.col(c) for c in names])
    assert by_text(got.collect()) == by_text(cur.fetchall()) and got.where("rank is not null").count() > 5
