"""The pipeline on a small corpus with planted cases, stage by stage and as a whole."""

import random
import re
from hashlib import sha256
from pathlib import Path

import corpus_pipeline
from lsnframe.llm.queries import piece_model

WORDS = "the of and thing erst is that on house tree with from water under light".split()  # noqa: SIM905


def test_pipeline(spark, tmp_path):
    import sentencepiece

    r = random.Random(9)
    prose = lambda n: " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))
    leak = prose(25)
    rows = [(i, prose(80), "en") for i in range(40)]
    rows += [
        (50, rows[3][1], "en"),
        (51, rows[4][1] + " end", "en"),
        (52, "123 456 !!", "en"),
        (53, None, None),
        (54, prose(9) + " " + leak, "en"),
        (55, prose(30) + " password=7602ad27cf5550de1c " + prose(9), "en"),
    ]
    df = spark.createDataFrame(
        [(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long"
    )
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, gone = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {x.doc_id for x in docs.collect()}
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == df.columns
        gone.append(before - {x.doc_id for x in docs.collect()})
    assert gone == [{52, 53}, {50, 51}, {54}, set()]
    row = docs.where("doc_id = 55").first()
    assert "7602ad27cf5550de1c" not in row.text and "<ASSIGNED_SECRET>" in row.text and row.n_chars == len(row.text)
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    kept = {x.doc_id: x.text for x in docs.collect()}
    got = {x.doc_id: x.n_tokens for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: len(sp.encode(t)) for i, t in kept.items()}


def plain_words(text, keep):
    return "".join(c if keep(c) else " " for c in text).split()


def brute_pipeline(rows, leaks):
    """What is left of rows (id, text) by plain loops: letters, near copies, benchmark windows, a pattern of secrets."""
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    sets = []
    for _, t in rows:
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    first = {}
    for k, (i, _) in enumerate(rows):
        if group[k] not in first or (i is None, i or 0) < (rows[first[group[k]]][0] is None, rows[first[group[k]]][0] or 0):
            first[group[k]] = k
    norm = lambda t: plain_words(t.lower(), lambda c: c.isalnum() or ord(c) > 127)
    windows = {tuple(w[k : k + 10]) for w in map(norm, leaks) for k in range(len(w) - 9)}
    out = []
    for k in sorted(first.values()):
        i, t = rows[k]
        w = norm(t)
        if not any(tuple(w[j : j + 10]) in windows for j in range(len(w) - 9)):
            out.append((i, re.sub(r"(password=)[0-9a-f]{18,}", r"\1<ASSIGNED_SECRET>", t)))
    return out


def test_pipeline_against_plain_loops(spark, tmp_path):
    """Every column may be null, ids repeat, texts are empty, long or tied, and other columns have names that stages use."""
    import sentencepiece

    r = random.Random(19)
    prose = lambda n: " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))
    leaks = [prose(25), prose(12)]
    rows = [(i, prose(r.randint(8, 120))) for i in range(60)]
    rows += [(100 + i, " ".join(t.split()[: -1 - i % 2])) for i, t in rows[:20]]
    rows += [(None, rows[5][1]), (7, rows[7][1]), (7, rows[7][1]), (None, prose(40)), (200, None), (201, ""), (202, "12 34"), (None, None)]
    rows += [(300 + i, f"{prose(20)} {leak} {prose(5)}") for i, leak in enumerate(leaks)] + [
        (310, prose(30) + " password=" + "%030x" % r.getrandbits(120) + " " + prose(9)), (320, prose(60_000))
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, w string, hits int, one long, found string, component_id long, language string"
    full = [(i, t, "en" if k % 7 else None, None, None, k, None, 3, 4, "x", 5, "y") for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(full, schema).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    spark.createDataFrame([(i, t) for i, t in enumerate(leaks)], "item_id long, text string").write.parquet(str(tmp_path / "a" / "benchmark.parquet"))
    want = brute_pipeline(rows, leaks)
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    got = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    digest = lambda ids: sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert sorted((x.doc_id or -1, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in got) == sorted(
        (i or -1, len(ids), digest(ids), sha256(sp.decode(ids).encode()).hexdigest()) for i, t in want for ids in [sp.encode(t)]
    )
    assert not list(Path(spark.conf.get("spark.checkpoint.dir")).glob("corpus-*"))
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "b" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
