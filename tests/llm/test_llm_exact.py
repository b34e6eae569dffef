"""Operators against brute force of their own definitions, against SQL, and on very long texts."""

import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import fingerprint, langid, maxent, minhash, mixing, passages, pieces, queries, resampling, secrets, session

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    cur = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(cur.fetchall())


def test_spread_keeps_all_rows_of_shared_buckets():
    import pyarrow as pa

    rng = random.Random(1)
    rows = sorted((rng.randint(0, 60), i, 5) for i in range(80))
    want = Counter(b for b, _, _ in rows)
    for size in (1, 7, 80):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[k : k + size])], ["bucket", "id", "n"]) for k in range(0, 80, size)]
        got = [tuple(r.values()) for b in minhash._spread(iter(batches)) for r in b.to_pylist()]
        edges = {rows[0][0], rows[-1][0]}
        assert sorted(got) == [r for r in rows if want[r[0]] > 1 or r[0] in edges]


def test_tiles_join_the_components_that_pairs_join():
    rng = np.random.default_rng(2)
    for _ in range(20):
        bases = [rng.integers(0, 2**60, 30).astype(np.uint64) for _ in range(3)]
        packs = []
        for _ in range(2):
            sets = []
            for _ in range(25):
                b = bases[rng.integers(3)].copy()
                b[: rng.integers(0, 6)] = rng.integers(0, 2**60)
                sets.append(np.unique(b))
            packs.append(sets)
        comps = [np.arange(25) // 2, 100 + np.arange(25) // 2]
        a, b = minhash.tile(*[(c, np.array([len(x) for x in s]), np.concatenate(s)) for c, s in zip(comps, packs)], 80)
        links = {(comps[0][i], comps[1][j]) for i, x in enumerate(packs[0]) for j, y in enumerate(packs[1]) if 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))}

        def classes(edges):
            root = {x: x for c in comps for x in c}
            for x, y in edges:
                x, y = root[x], root[y]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
            return root

        assert classes(zip(a, b)) == classes(links) and len(a) <= 26


def _near_words():
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(40)]
    return [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60))) for _ in range(120)]


def test_mixing_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src2", "src3", "odd", None])) for i, t in enumerate(_near_words())]
    rows += [rows[5], (None, "a b c", "en", "src0"), (200, None, "en", "src0"), (201, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    mix = mixing.Mix(weights={("web",): 0.7, ("web", "en"): 0.9}, share=0.45, epochs=2, seed=5)
    got = mixing.apply(docs, mix).collect()
    size = lambda t: len((t or "").split())
    domain = lambda s: "other" if not (s or "").startswith("src") else {0: "web", 1: "web", 2: "reference", 3: "forum"}[int(s[3:]) % 4]
    leaves = defaultdict(list)
    for r in rows:
        leaves[domain(r[3]), r[2], r[3]].append(r)
    have = {p: sum(size(r[1]) for r in v) for p, v in leaves.items()}

    def share(budget, kids):  # one unit after another to the child that is furthest below its share
        got, units = [0.0] * len(kids), 20000
        for _ in range(units):
            open_ = [k for k, (w, c) in enumerate(kids) if w > 0 and got[k] + budget / units <= c + 1e-9]
            if not open_:
                break
            k = min(open_, key=lambda k: (got[k] + budget / units) / kids[k][0])
            got[k] += budget / units
        return got

    for budget, kids in ((100, [(1, 10), (1, 30), (2, 1000)]), (60, [(0.5, 100), (0.2, 5), (0.3, 9)]), (500, [(1, 10), (3, 40)])):
        assert all(abs(a - b) < 0.2 for a, b in zip(share(budget, kids), mixing.divide(budget, kids)))
    want = mixing.budgets(have, mix)
    assert sum(want.values()) <= 0.45 * sum(have.values()) + 1e-6 and sum(want.values()) >= 0.45 * sum(have.values()) - len(want)
    for path, own in leaves.items():
        n, budget = have[path], want[path]
        epochs, rest = divmod(budget, n) if n else (mix.epochs, 0)
        ids = spark.createDataFrame([(r[0] if r[0] is not None else -(2**63), size(r[1])) for r in own], "id long, n long")
        order = sorted((r.h % 2**64, r.id, r.n) for r in ids.select("id", "n", F.xxhash64(F.lit(mix.seed), F.lit(epochs).cast("long"), "id").alias("h")).collect())
        taken, total = set(), 0
        for h, i in sorted({x[:2] for x in order}):  # rows of one id go together
            total += sum(m for a, b, m in order if (a, b) == (h, i))
            if total <= rest:
                taken.add((h, i))
        last = max(taken, default=None)
        expect = Counter((i, epochs + int(rest > 0 and last is not None and (h, i) <= last)) for h, i, _ in order)
        have_rows = Counter((r.doc_id if r.doc_id is not None else -(2**63), r.copies) for r in got if (r.domain, r.lang, r.source) == path)
        assert have_rows == expect, path


def test_resampling_against_brute_force(spark):
    texts = _near_words() + [None, " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 10 == 1)) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in resampling.select(docs, labels).collect()}

    def own(t):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        return resampling.grams(raw, np.array([0, len(raw)]))[0].tolist()

    count = [Counter(), Counter()]
    for i, t in enumerate(texts):
        assert len(own(t)) == max(0, 2 * len((t or "").split()) - 1)
        count[0].update(own(t))
        if i < 60 and i % 2 and i % 10 != 1:
            count[1].update(own(t))
    sums = [sum(c.values()) + resampling.BUCKETS for c in count]
    ids = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.lit(11), "doc_id").alias("h")).collect()}
    keys = {}
    for i, t in enumerate(texts):
        g = own(t)
        if not g:
            assert got[i].log_ratio is None and not got[i].kept
            continue
        mean = sum(math.log((count[1][b] + 1) / sums[1]) - math.log((count[0][b] + 1) / sums[0]) for b in g) / len(g)
        even = ((ids[i] % 2**64 >> 11) + 0.5) / 2**53
        keys[i] = mean / resampling.TEMPERATURE - math.log(-math.log(even))
        assert math.isclose(got[i].log_ratio, mean, abs_tol=1e-9) and math.isclose(got[i].key, keys[i], abs_tol=1e-6)
    k = int(resampling.SHARE * len(keys) + 0.5)
    assert {i for i in keys if got[i].kept} == set(sorted(keys, key=lambda i: -keys[i])[:k])


def test_language_against_brute_force(spark):
    rng = random.Random(6)
    words = {"en": "the and river stone walk".split(), "de": "der und fluss stein über".split(), "xx": "ola mar rio casa lua".split()}
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(rng.randint(1, 12))), g) for i, g in enumerate(rng.choices(["en", "de", "xx"], k=90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in langid.predict(docs.select("doc_id", "text"), langid.train(docs.where("doc_id < 60").select("lang", "text"))).collect()}
    count = {g: Counter() for g in words}
    for i, t, g in rows[:60]:
        count[g].update(langid.grams([t])[0].tolist())
    for i, t, _ in rows:
        own = langid.grams([t])[0].tolist()
        logs = {g: sum(math.log((c[b] + 0.5) / (sum(c.values()) + 0.5 * langid.BUCKETS)) for b in own) for g, c in count.items()}
        best = min(logs, key=lambda g: (-logs[g], g))
        score = 1 / sum(math.exp(x - logs[best]) for x in logs.values())
        assert got[i].lang_pred == best and math.isclose(got[i].score, score, abs_tol=1e-4)


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(7)
    part = lambda n, k: " ".join(f"{k}{rng.randint(0, 10**6)}" for _ in range(n))
    a, b, big, other = part(60, "a"), part(40, "b"), part(4000, "c"), part(4000, "d")
    df = spark.createDataFrame([(a, f"{a} {b}", ""), (big, f"{big} {other}", "x")], "a string, b string, c string")
    s = df.select(fingerprint.sketch("a").alias("a"), fingerprint.sketch("b").alias("b"), fingerprint.sketch("c").alias("c"))
    r = s.select((fingerprint.merge("a", "b") == F.slice(F.array_sort(F.array_union("a", "b")), 1, 128)).alias("m"), fingerprint.containment("a", "b").alias("in"), fingerprint.resemblance("a", "b").alias("near"), fingerprint.distinct_shingles("b").alias("n"), fingerprint.containment("c", "a").alias("none")).collect()
    assert all(x.m for x in r) and r[0]["in"] == 1.0 and r[0].n == 96 and math.isclose(r[0].near, 56 / 96) and r[0].none == 0
    assert r[1]["in"] > 0.75 and abs(r[1].near - 0.5) < 0.15 and abs(r[1].n / 7996 - 1) < 0.3
    whole = spark.createDataFrame([(a,), (b,), (f"{a} | {b}",)], "t string").select(fingerprint.sketch("t", 10**6, 1).alias("s")).collect()
    assert set(whole[0].s) | set(whole[1].s) <= set(whole[2].s)


def test_random_strings_are_spans_and_words_are_not(spark):
    rng = random.Random(8)
    plain = ["the long walk by the river went over hills and through some forests until evening came", "some-hyphenated-words-in-a-row", "A_CONSTANT_NAME_OF_WORDS", "CamelCaseIdentifierName", "path/to/some/ordinary/file"] * 40
    drawn = {a: ["".join(rng.choice(a) for _ in range(28)) for _ in range(20)] for a in secrets.DRAWN}
    rows = [(i, t) for i, t in enumerate(plain)] + [(1000 + k, f"see {t} there") for k, t in enumerate(t for v in drawn.values() for t in v)]
    corpus = spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 10_000).alias("doc_id"), "text")  # ordinary text to learn from
    got = {r.doc_id: r.spans for r in secrets.report(spark.createDataFrame(rows, "doc_id long, text string").unionByName(corpus)).collect()}
    assert not any(got[i] for i in range(len(plain)))
    hits = [bool(got[1000 + k]) for k in range(20 * len(drawn))]
    for k in range(len(drawn)):
        assert sum(hits[20 * k : 20 * k + 20]) >= 18
    assert all("random:4:32" in got[1000 + k] for k in range(20) if hits[k])


def test_masks_many_overlapping_spans(spark):
    import re

    text = "é " + " ".join(f"password={k:016x}abc AKIA{'Q' * 16}{k} x" for k in range(600))
    df = spark.createDataFrame([(1, text, 0), (2, None, 0)], "doc_id long, text string, n_chars long")
    base = {r.row.doc_id: r.base for r in secrets.scan(df).select("row", "base").collect()}[1]
    at, out = 0, ""
    for a, b, _ in sorted(tuple(x) for x in base):
        if a >= at:
            out, at = out + text[at:a] + "[secret]", b
        else:
            at = max(at, b)
    got = {r.doc_id: r for r in secrets.masked(df).collect()}
    assert got[1].text == out + text[at:] and got[1].n_chars == len(got[1].text) and got[2].text is None
    assert len(re.findall(r"\[secret\]", got[1].text)) == 1200


def test_very_long_texts_and_clashing_columns(spark):
    session.workers_find_package(spark)
    rng = random.Random(9)
    vocab = [f"word{k}" for k in range(3000)]
    long = " ".join(rng.choice(vocab) for _ in range(150_000))
    rows = [(1, long, "en", "src0", len(long)), (2, long[:-7] + " changed", "en", "src0", len(long)), (3, "x" * 1_000_000, "en", "src1", 1_000_000), (4, "short text", "de", None, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("q") for c in ("row", "score", "spans", "base", "id", "key", "copies", "h")}).repartition(2)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, width=2).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert (2, 1) in {(r.doc_id, r.other_id) for r in passages.repeated_passages(docs).collect()}
    assert {r.doc_id: r.ok for r in pieces.encode(docs).join(docs.select("doc_id", "text"), "doc_id").select("doc_id", (F.col("decoded") == F.col("text")).alias("ok")).collect()} == dict.fromkeys((1, 2, 3, 4), True)
    for f in (maxent.score, mixing.apply, lambda d: resampling.select(d, labels), fingerprint.compare_edited, langid.identify, secrets.report):
        assert f(docs).count() == 4
    assert secrets.masked(docs).columns == docs.columns and secrets.masked(docs).where("score = 'q'").count() == 4


def test_stages_keep_columns_nulls_and_repeats(spark):
    import corpus_pipeline as C

    rng = random.Random(10)
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    en, de = "the and river stone walk night house with some more words here".split(), "der und fluss stein nacht haus gehen mit einige worte hier noch".split()
    a, b = say(en, 80), say(de, 90)
    rows = [(k, say(en if k % 2 else de, 60), "en" if k % 2 else "de") for k in range(20, 40)]
    rows += [(1, a, "en"), (1, a, "en"), (1, b, "de"), (2, a, "en"), (None, a, "en"), (None, None, None), (3, "", None), (4, "1234", "en"), (5, f"{say(en, 30)} password=abcdefgh1234567", "en")]
    docs = spark.createDataFrame([(*r, "src0", len(r[1] or ""), "p", 0.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double").repartition(3)
    one = session.settle(C.language(spark, docs, ""))
    assert one.columns == docs.columns and one.where("score <> 0 or lang_pred <> 'p'").isEmpty()
    texts = Counter((r.doc_id, r.text) for r in one.collect())
    assert texts == Counter((i, t) for i, t, _ in rows if t not in (None, "", "1234"))
    two = session.settle(C.near_copies(spark, one, ""))
    left = Counter((r.doc_id, r.text) for r in two.collect())
    assert two.columns == docs.columns and left == Counter({k: 1 for k in texts if k[0] != 2})
    three = session.settle(C.mask_secrets(spark, two, ""))
    assert three.columns == docs.columns and three.count() == two.count() and "abcdefgh1234567" not in three.where("doc_id = 5").first().text
    four = session.settle(C.mix(spark, three, ""))
    assert four.columns == docs.columns and set(four.select("text").collect()) <= set(three.select("text").collect())
    five = C.tokens(spark, four, "")
    assert five.count() == four.count() and five.where("n_tokens <> size(ids)").isEmpty()
    for k, (_, stage) in enumerate(C.STAGES):
        assert stage(spark, docs.where("false"), "").count() == 0


def test_near_copies_move_few_texts(spark):
    import corpus_pipeline as C

    rng = random.Random(12)
    texts = [" ".join(f"{rng.getrandbits(24):06x}" for _ in range(5000)) for _ in range(200)]
    texts[50] = texts[20] + " more"
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, texts[20], "x")]
    docs = session.settle(spark.createDataFrame(rows, "doc_id long, text string, _part string").repartition(4))

    def moved() -> int:
        store, jvm = spark._jsc.sc().statusStore(), spark._jvm
        found = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(found.apply(k).shuffleWriteBytes() for k in range(found.size()))

    before, small = moved(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = C.near_copies(spark, docs, "").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert Counter((r.doc_id, r.text) for r in left) == Counter((k, t) for k, t, _ in rows if k != 50)
    assert moved() - before < sum(map(len, texts)) / 4


def test_lm_steps_against_one_row_at_a_time():
    """AdaGrad steps of batches whose rows repeat once, a few times and often, against sums row by row."""
    rng = np.random.default_rng(5)
    for wide, spread in ((3, 40), (1, 3), (3, 5000), (1, 1)):
        table = rng.normal(size=(spread, 4)).astype(np.float32)
        learner = maxent._Learner(table, 0.1)
        want, power, met = table.astype(float), np.zeros(spread), np.zeros(spread, int)
        for _ in range(4):
            at, error = rng.integers(0, spread, (200, wide)), rng.normal(size=(200, 4)).astype(np.float32)
            learner.step(at, error)
            sums = np.zeros((spread, 4))
            for i in range(200):
                for j in at[i]:
                    sums[j] += error[i]
                    met[j] += 1
            hit = np.unique(at)
            power[hit] += (sums[hit] ** 2).mean(axis=1)
            want[hit] -= 0.1 * sums[hit] / np.sqrt(power[hit] + 1e-6)[:, None]
        assert np.allclose(learner.table, want, atol=1e-3) and learner.met.tolist() == met.tolist() and (learner.start == table).all()


def test_hashes_are_found_where_they_are():
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 1000, 70_000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        h = np.concatenate((keys[::3], rng.integers(0, 2**64, 500, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)))
        place = {int(x): k for k, x in enumerate(keys)}
        assert maxent.find(keys, *maxent.starts(keys), h).tolist() == [place.get(int(x), -1) for x in h]


def test_pieces_against_all_segmentations_with_ties():
    """Small models with many equal scores: of all segmentations the best, and of equally good ones that with the longer last piece, and so on before it."""
    import struct

    from sitelens.llm import pieces

    def message(name, score, kind):
        own = b"\x0a" + bytes([len(name)]) + name + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind])
        return b"\x0a" + bytes([len(own)]) + own

    rng = random.Random(11)
    for _ in range(40):
        words = {"a", "b", "c", *("".join(rng.choice("abc") for _ in range(rng.randint(2, 4))) for _ in range(8))}
        scores = {w: -float(rng.choice([1, 2, 2, 3])) * len(w) for w in words}
        names = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)], *sorted(words)]
        raw = message(b"<unk>", 0.0, 2) + b"".join(message(n.encode(), 0.0, 6) for n in names[1:257]) + b"".join(message(w.encode(), scores[w], 1) for w in sorted(words))
        model = pieces.load(raw)
        lone = min([0.0, *scores.values()]) - 10
        for _ in range(25):
            s = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 8)))

            def every(n, s=s):
                if not n:
                    yield 0.0, ()
                for size in range(1, n + 1):
                    own = s[n - size : n]
                    if own in scores or size == 1 and own not in scores:
                        for score, rest in every(n - size):
                            yield score + scores.get(own, lone), (size, *rest)

            _, sizes = max(every(len(s)))
            cut, at = [], len(s)
            for size in sizes:
                own = s[at - size : at]
                cut = ([names.index(own)] if own in scores else [1 + b for b in own.encode()]) + cut
                at -= size
            assert model.best(s) == cut, (s, sizes)


def test_many_copies_and_clashing_columns_of_vectors(spark):
    """700 copies under one label, near ones beside them, and columns named like those of the plan."""
    from sitelens.llm import vectors

    session.workers_find_package(spark)
    rng = np.random.default_rng(3)
    base = rng.normal(size=6)
    rows = [(i, [float(x) for x in base], 1) for i in range(700)] + [(700 + i, [float(x) for x in base + rng.normal(size=6) * 0.01], 1) for i in range(20)] + [(800 + i, [float(x) for x in base], 2) for i in range(3)] + [(900, [float(x) for x in -base], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for c in ("dim", "pack", "a", "b", "x", "y", "id", "component", "n_links", "component_id", "kept", "row", "vectors", "cell"):
        df = df.withColumn(c, F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == (719, 0, i == 0) for i in range(720)) and all(got[800 + i] == (2, 800, i == 0) for i in range(3)) and got[900] == (0, 900, True)
