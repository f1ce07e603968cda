"""Operators over whole corpora, against brute force on small ones with planted cases."""

import random
import re
from hashlib import sha256

import numpy as np
import pytest

from lsnframe.llm import decontamination, embedding_dedup, near_dedup, substring_dedup
from lsnframe.llm.components import components
from lsnframe.llm.decontamination import keep_clean, remove_spans, scan
from lsnframe.llm.embedding_dedup import near_vectors
from lsnframe.llm.near_dedup import keep_one, near_duplicates
from lsnframe.llm.substring_dedup import remove_repeats

SCHEMA = "doc_id long, text string, w int, row string, key int, n_words int"  # columns with clashing names


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], SCHEMA)


def prose(r, n, size=400):
    return " ".join(f"w{r.randint(0, size)}" for _ in range(n))


@pytest.mark.parametrize("local", [200_000, 40])
def test_components(spark, local):
    """In one partition, and in several with stars; with a hub of more rows than a task takes."""
    edges = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(200, 200), (7, 3)] + [(1000, k) for k in range(1001, 1700)] + [
        (5000 - i, 4999 - i) for i in range(200)
    ]
    random.Random(1).shuffle(edges)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(8), local=local).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)} | {i: 1000 for i in range(1000, 1700)} | {
        i: 4800 for i in range(4800, 5001)
    }
    assert components(spark.createDataFrame([], "a long, b long"), local=local).count() == 0


# substrings


def brute_repeats(rows, window):
    docs = sorted((i, re.findall("[^ \t-\r]+", t or "")) for i, t in rows if i is not None)
    seen, gone = {}, {i: set() for i, _ in docs}
    for i, w in docs:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if seen.setdefault(k, (i, s)) < (i, s):
                gone[i].update(range(s, s + window))
    return {i: (len(w), len(gone[i]), sha256(" ".join(x for p, x in enumerate(w) if p not in gone[i]).encode()).hexdigest()) for i, w in docs}


@pytest.mark.parametrize("hot", [100_000, 2])
def test_substring_dedup(spark, hot):
    """With minimisers that share buckets, and with nearly all of them split into windows."""
    r = random.Random(1)
    passage = prose(r, 55)
    rows = [(i, prose(r, r.randint(0, 80)) + (" " + passage + "\t" if i % 3 == 0 else "") + prose(r, 20)) for i in range(60)]
    rows += [
        (100, "a b " * 60),
        (101, "x " * 100),
        (102, None),
        (103, ""),
        (104, passage),
        (105, passage),
        (106, " \n\t"),
        (107, "é ü " * 30),
        (108, prose(r, 3000)),
    ]
    rows += [(200, rows[0][1]), (201, rows[0][1])]
    r.shuffle(rows)
    want = brute_repeats(rows, 20)
    df = frame(spark, rows).repartition(3)
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in remove_repeats(df, window=20, buckets=5, hot=hot).collect()}
    assert got == want
    assert sum(x[1] > 0 for x in want.values()) > 20


def test_substring_dedup_of_a_very_long_text(spark):
    text = prose(random.Random(3), 300_000, 100_000)
    got = {
        x.doc_id: (x.n_words, x.n_removed) for x in remove_repeats(
            frame(spark, [(1, text), (2, text + " end"), (3, "x y " * 200_000)]), window=20
        ).collect()
    }
    assert got == {1: (300_000, 0), 2: (300_001, 300_000), 3: (400_000, 399_998)}


def test_substring_dedup_of_null_and_repeated_rows(spark):
    text = " ".join(map(str, range(30)))
    df = frame(spark, [(1, text), (1, text), (None, text), (None, None), (2, text)]).repartition(2)
    got = sorted(((x.doc_id or 0), x.n_words, x.n_removed) for x in remove_repeats(df, window=20).collect())
    assert got == [(0, 0, 0), (0, 30, 0), (1, 30, 0), (1, 30, 0), (2, 30, 30)]
    assert remove_repeats(frame(spark, []), window=20).count() == 0
    kept = remove_repeats(frame(spark, [(1, text + " tail"), (2, "head " + text)]), window=20, keep_text=True).orderBy("doc_id").collect()
    assert [k.text for k in kept] == [text + " tail", "head"]


# near duplicates


def brute_near(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall("[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[p : p + k]) for p in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if sets[i] and sets[j] and root(i) != root(j):
                n = len(sets[i] & sets[j])
                if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (len(sets[i]), root(i)) for i in ids}


def changed(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"z{r.randint(0, 10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("k", "block"), [(2, 1500), (5, 1500), (2, 16)])
def test_near_dedup(spark, monkeypatch, k, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    r = random.Random(k)
    core, rows = prose(r, 150), []
    for i in range(70):  # one group around the threshold, whose smallest member links with few
        rows.append((i, changed(r, core, r.randint(3, 12))))
    rows[0] = (0, changed(r, core, 14))
    for i in range(100, 160):
        base = prose(r, r.randint(1, 120))
        rows += [(i, base), (i + 100, changed(r, base, r.randint(0, 4)))]
    rows += [
        (500, None),
        (501, ""),
        (502, "One"),
        (503, "oNE"),
        (504, "É one"),
        (505, "é one"),
        (506, " \n"),
        (507, core.upper()),
        (508, core),
        (509, core),
    ]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(frame(spark, rows).repartition(3), k=k).collect()}
    assert got == brute_near(rows, k, 80)


def test_near_dedup_of_null_and_repeated_rows(spark):
    df = frame(spark, [(3, "a b c"), (3, "a b c"), (None, "a b c"), (9, "A B C")])
    got = sorted(((x.doc_id or 0), x.component_id, x.kept) for x in near_duplicates(df, k=2).collect())
    assert got == [(0, None, True), (3, 3, True), (3, 3, True), (9, 3, False)]
    assert near_duplicates(frame(spark, []), k=2).count() == 0


def test_estimate_is_close():
    r = np.random.default_rng(0)
    for j in (0.2, 0.5, 0.8, 0.95):
        both = int(2000 * j / (1 + j) * 2)
        s = np.unique(r.integers(0, 2**64, 4000 - both, dtype=np.uint64))
        a, b = np.sort(s[:2000]), np.sort(np.concatenate((s[:both], s[2000:])))
        regs = near_dedup._registers(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        got = near_dedup.estimate(regs[:1], regs[1:], np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(got - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.2


# decontamination


def clean_words(t):
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_hits(rows, items, window):
    wins = {}
    for item, t in items:
        w = clean_words(t)
        n = min(len(w), window)
        for s in range(len(w) - n + 1) if w else ():
            wins.setdefault(tuple(w[s : s + n]), set()).add(item)
    out = {}
    for i, t in rows:
        w, hit, found = clean_words(t), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit.update(range(s, s + n))
                    found |= wins[tuple(w[s : s + n])]
        out[i] = (len(w), len(hit), len(found), sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("most", [64 << 20, 700])
def test_decontamination(spark, most):
    r = random.Random(6)
    items = [(i, prose(r, r.randint(11, 30), 50)) for i in range(12)] + [
        (20, "Short Item, five words HERE"),
        (21, "Über"),
        (22, ""),
        (23, None),
        (24, "one two three four five six seven eight nine"),
        (25, "Short item five words here"),
    ]
    rows = [(i, prose(r, 60, 50)) for i in range(40)]
    for i in range(40, 60):
        w = items[i % 12][1].upper().split()
        cut = w[r.randint(0, 3) :]
        rows.append((i, prose(r, r.randint(0, 9), 50) + ".\n" + "--".join(cut) + "!" + prose(r, r.randint(0, 9), 50)))
    rows += [
        (70, None),
        (71, ""),
        (72, "a short-item five (words) here."),
        (73, "über"),
        (74, "ÜBER"),
        (75, "x one two three four five six seven eight nine y"),
        (76, items[0][1] * 3),
        (77, items[0][1]),
    ]
    df, bench = frame(spark, rows), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in scan(df, bench, most_bytes=most).collect()}
    want = brute_hits(rows, items, 10)
    assert got == want and any(x[4] for x in want.values())
    if most > 700:
        left = keep_clean(df, bench)
        assert left.columns == df.columns and {x.doc_id for x in left.collect()} == {i for i, x in want.items() if not x[4]}


def test_decontamination_cuts_spans(spark):
    r = random.Random(16)
    items = [(i, prose(r, r.randint(10, 14), 50)) for i in range(4)] + [(9, "Über den Fluß")]
    pattern = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
    rows = [
        (
            i,
            f"{'! ' * (i % 2)}{prose(r, i % 4, 50)} {items[i % 4][1].upper()}{' -- ' + items[(i + 1) % 4][1] if i % 3 else ','} {prose(r, i % 5, 50)}.",
        ) for i in range(12)
    ]
    rows += [(20, None), (21, ""), (22, "clean text, all of it"), (23, "ÜBER, über den Fluß über den Fluß! 😀 end"), (24, items[0][1])]
    want = {}
    for i, t in rows:
        spans = list(pattern.finditer(t or ""))
        w = [m[0].translate({c: c + 32 for c in range(65, 91)}) for m in spans]
        hit = set()
        for _, item in items:
            v = clean_words(item)
            n = min(len(v), 10)
            for k in range(len(v) - n + 1):
                hit |= {x for s in range(len(w) - n + 1) if w[s : s + n] == v[k : k + n] for x in range(s, s + n)}
        gone = {c for x in hit for c in range(spans[x].start(), spans[x + 1].start() if x + 1 in hit else spans[x].end())}
        want[i] = t and "".join(c for k, c in enumerate(t) if k not in gone)
    df, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    out = remove_spans(df, bench)
    assert out.columns == df.columns and {x.doc_id: x.text for x in out.collect()} == want and want[22] == rows[-3][1]
    assert {x.doc_id: x.text for x in remove_spans(df, bench.limit(0)).collect()} == dict(rows)


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    df = frame(spark, [(1, "a b c"), (1, "a b c"), (None, "x a b c")])
    assert sorted((x.doc_id or 0, x.n_hit) for x in scan(df, bench).collect()) == [(0, 3), (1, 3), (1, 3)]
    assert scan(frame(spark, []), bench).count() == 0
    assert [x.contaminated for x in scan(df, bench.limit(0)).collect()] == [False] * 3


def test_decontamination_plan_has_no_python(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    plan = scan(frame(spark, [(1, "a b c")]), bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("Scan ExistingRDD", ""))


# vectors


@pytest.mark.parametrize("block", [1500, 20])
def test_embedding_dedup(spark, block):
    r = np.random.default_rng(4)
    x = r.normal(size=(250, 64))
    near = np.repeat(x[:1], 60, 0) + r.normal(size=(60, 64)) * 0.12
    pairs = x[10:60] + r.normal(size=(50, 64)) * r.uniform(0.05, 0.3, (50, 1))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.concatenate((x, near, pairs)))]
    rows += [(500 + i, rows[7][1]) for i in range(5)] + [
        (600, None),
        (601, [0.0] * 64),
        (602, [float("nan")] * 64),
        (603, [float("inf")] + [0.0] * 63),
        (604, [None] + [1.0] * 63),
        (605, []),
        (606, [1.0, 2.0]),
        (607, [2 * v for v in rows[8][1]]),
    ]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, key int, rep int")
    got = {q.vec_id: (q.n_links, q.component_id, q.kept) for q in near_vectors(df, block=block).collect()}
    good = [(i, np.array(v, np.float64)) for i, v in rows if v and len(v) == 64 and None not in v and np.isfinite(v).all() and any(v)]
    e = np.array([v / np.linalg.norm(v) for _, v in good])
    hit = e @ e.T >= 0.95
    np.fill_diagonal(hit, False)
    label = np.arange(len(e))
    for _ in range(len(e)):
        label = np.minimum(label, np.where(hit, label[None], len(e)).min(1))
    ids = [i for i, _ in good]
    want = {i: (int(hit[p].sum()), ids[label[p]], ids[label[p]] == i) for p, i in enumerate(ids)} | {i: (0, i, True) for i in range(600, 607)}
    found, true = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert found <= true and found >= 0.99 * true
    same = [i for i in want if got[i][0] <= want[i][0]]
    assert len(same) == len(want) and sum(got[i] == want[i] for i in want) >= 0.97 * len(want)


def test_embedding_dedup_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (None, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((q.vec_id or 0, q.n_links, q.kept) for q in near_vectors(df).collect()) == [(0, 0, True), (1, 0, True), (2, 0, True)]
    assert near_vectors(df.limit(0)).count() == 0


def test_filters_judge_rows_and_not_ids(spark):
    r = random.Random(12)
    prose = lambda n: " ".join(f"w{r.randint(0, 999)}" for _ in range(n))
    a, b, c, leak = prose(60), prose(60), prose(60), prose(20)
    schema = "doc_id long, text string, row int, w int"
    rows = [
        (None, a, 1, 0),
        (7, a, 2, 0),
        (7, a + " end", 3, 0),
        (None, b, 4, 0),
        (None, b, 5, 0),
        (8, c, 6, 0),
        (8, c, 7, 0),
        (9, None, 8, 0),
        (None, "", 9, 0),
    ]
    got = keep_one(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "row", "w"]
    kept = sorted(x.row for x in got.collect())
    assert len(kept) == 5 and kept[0] in (2, 3) and kept[1] in (4, 5) and kept[2] in (6, 7) and kept[3:] == [8, 9]
    rows = [(None, "x " + leak, 1, 0), (None, prose(30), 2, 0), (5, leak + " y", 3, 0), (5, prose(30), 4, 0), (6, None, 5, 0), (None, None, 6, 0)]
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    for most in (64 << 20, 700):  # one part, and several
        left = keep_clean(spark.createDataFrame(rows, schema), bench, most_bytes=most)
        assert left.columns == ["doc_id", "text", "row", "w"] and sorted(x.row for x in left.collect()) == [2, 4, 5, 6]


def test_vectors_of_each_length_meet(spark):
    r = np.random.default_rng(2)
    rows = []
    for dims, n in ((8, 30), (5, 10), (3, 1)):
        x = r.normal(size=(n, dims))
        rows += [y.tolist() for v in x for y in (v, v + 0.01 * r.normal(size=dims))]
    got = {x.vec_id: x for x in near_vectors(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")).collect()}
    unit = [np.array(x) / np.linalg.norm(x) for x in rows]
    for i, x in enumerate(unit):
        links = [j for j, y in enumerate(unit) if j != i and len(x) == len(y) and x @ y >= 0.95]
        assert got[i].n_links == len(links) > 0 and got[i].component_id <= min(links)


def test_as_many_vectors_are_found_with_more_pivots():
    r = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    a, z = unit(r.normal(size=(8000, 64))), r.normal(size=(8000, 64))
    b = 0.95 * a + (1 - 0.95**2) ** 0.5 * unit(z - (z * a).sum(1)[:, None] * a)
    sizes = [embedding_dedup.index_size(n) for n in (1, 200_000, 200_001, 800_001, 3_200_001, 12_800_001)]
    assert sizes == [(128, 7), (128, 7), (256, 8), (512, 8), (1024, 9), (2048, 9)]
    for pivots, near in sizes[1:]:
        at = embedding_dedup.choose_pivots(unit(r.normal(size=(max(4096, 2 * pivots), 64))), pivots)
        p, q = (embedding_dedup.ordered(x, at, near) for x in (a, b))
        same = p[:, :, None] == q[:, None, :]
        nearness = np.arange(near, 0, -1)
        found = (same.sum((1, 2)) >= 2) & ((same * nearness[:, None] * nearness).sum((1, 2)) >= 0.35 * near**2)
        assert found.mean() > 0.998


def test_what_is_broadcast_can_be_shuffled(spark, monkeypatch):
    """The same answers on both sides of the bounds of what is sent to every task."""
    r = random.Random(21)
    base = [prose(r, 40, 60) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t.replace("w1 ", "w2 ", 1)) for i, t in enumerate(base)] + [(200, None)]
    df, bench = frame(spark, rows), spark.createDataFrame([(1, base[3]), (2, base[4])], "item_id long, text string")
    x = np.random.default_rng(3).normal(size=(60, 8))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate((x, x + 0.01)))], "vec_id long, embedding array<double>")
    plain = lambda f: sorted(map(repr, f.collect()))
    runs = [
        lambda: plain(near_duplicates(df, k=2)),
        lambda: plain(keep_clean(df, bench)),
        lambda: plain(near_vectors(vectors)),
        lambda: plain(remove_repeats(df, hot=2)),
    ]
    sent = [f() for f in runs]
    for module, name in ((near_dedup, "MOST_SENT"), (decontamination, "MOST_GONE"), (embedding_dedup, "MOST_LISTS"), (substring_dedup, "MOST_HOT")):
        monkeypatch.setattr(module, name, 0)
    assert [f() for f in runs] == sent
