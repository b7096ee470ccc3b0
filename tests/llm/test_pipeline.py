"""The pipeline's stages take effect and its pieces cover what they should."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_corpus_operators import brute_components, brute_copies, plain_estimate, sentence
from tokenizers import Tokenizer

import corpus_pipeline
from tarnlight.llm import mixing, quality_rules
from tarnlight.llm.staging import Workspace

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    space = Workspace(spark, "test")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, inputs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(docs)
        docs = space.stage(stage(spark, docs, SF), name.replace(" ", "-"))
        if name != "packing":
            assert docs.columns == columns
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in inputs]
    assert ids[0] > ids[1] == ids[2] > ids[3] >= ids[4]
    assert docs.select("doc_id").distinct().count() == len(ids[4])
    texts = defaultdict(list)
    for r in inputs[4].select("doc_id", "text").collect():
        texts[r.doc_id].append(len(library.encode(r.text, add_special_tokens=False).ids) + 1)
    pieces = docs.groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r.doc_id: r["sum(length)"] for r in pieces} == {d: sum(n) for d, n in texts.items()}


def test_run_equals_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "minhash near-dedup", "mixing to target weights", "packing"]


def test_stages_take_awkward_rows(spark):
    """Nulls in every column, repeated rows, rows without a doc_id, one doc_id with two texts, an empty table."""
    good = " ".join(f"the river of word{i} and stone{i}" for i in range(60))
    other = " ".join(f"the lake of sand{i} and green{i}" for i in range(60))
    rows = [(1, good, "en", "a", 1), (1, good, "en", "a", 1), (2, good, None, None, None), (None, good, "en", "a", None), (None, good + " x", "en", "a", None)]
    rows += [(3, other, "en", "b", 1), (3, "$$$ ### " * 90, "en", "b", 1), (4, None, None, None, None), (5, "", "en", "c", 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    judged = corpus_pipeline.quality_stage(spark, docs, "")
    assert sorted((r.doc_id or 0, r.text[:8]) for r in judged.collect()) == [(0, good[:8])] * 2 + [(1, good[:8])] * 2 + [(2, good[:8]), (3, other[:8])]
    near = corpus_pipeline.near_stage(spark, docs, "").collect()
    assert sorted((r.doc_id or 0) for r in near) == [0, 0, 0, 1, 3, 3, 4, 5]
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, "")
            assert name == "packing" or out.columns == docs.columns
            assert (out.count() > 0) == (table is docs)


def small_corpus():
    rng = random.Random(21)
    rows = []
    for i in range(90):
        lines = [sentence(rng, rng.randint(5, 90)) for _ in range(rng.randint(1, 3))]
        lines.insert(rng.randint(0, len(lines)), rng.choice(["Subscribe to our letter now", " subscribe to OUR letter now ", "All rights reserved", f"line {i} alone"]))
        rows.append((i, "\n".join(lines), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), None))
    for i in range(90, 110):  # near copies and equal texts
        words = rows[i - 90][1].split(" ")
        words[len(words) // 2] = "changed"
        rows.append((i, " ".join(words) if i % 2 else rows[i - 90][1], "en", rng.choice("abc"), None))
    rows += [(200 + i, "$$ ## | && <> 123 %% " * 30, "en", "a", 1) for i in range(6)] + [(300, "the same words " * 60, "en", "b", 1), (301, None, None, None, None), (302, "short but good words of the river", "en", "c", 1), (303, "long " * 20_000, "en", "a", 1)]
    return rows


def test_each_stage_equals_brute_force(spark):
    """Every stage against plain Python on its own input; columns that bear the stages' helper names go along unharmed."""
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    space = Workspace(spark, "test")
    docs = space.stage(spark.createDataFrame(small_corpus(), "doc_id long, text string, lang string, source string, n_chars long"), "docs")
    for name, stage in corpus_pipeline.STAGES:
        rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
        out = space.stage(stage(spark, docs, ""), name.replace(" ", "-"))
        if name == "quality rules":
            judged = quality_rules.judge_quality(docs).collect()
            votes = [[r[f"vote_{x.name}"] for x in quality_rules.RULES] for r in judged]
            good = {r.doc_id for r, p in zip(judged, plain_estimate(votes), strict=True) if r.n_words >= 1 and 100 * r.n_repeat_words <= 50 * r.n_words and p >= 0.5}
            expect = Counter(r for r in rows if r[0] in good)
            assert {200, 300, 301, 303}.isdisjoint(good) and 302 in good
        elif name == "line dedup":
            def key(line):
                return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

            found = Counter(k for r in rows for k in {key(x) for x in r[1].split("\n")} if k)
            expect = Counter((r[0], "\n".join(x for x in r[1].split("\n") if not key(x) or found[key(x)] < 10), *r[2:]) for r in rows)
            assert max(found.values()) >= 10
        elif name == "minhash near-dedup":
            _, label = brute_components(rows, 5, 80)
            expect = Counter(r for r in rows if label[r[0]] == r[0])
            assert sum(expect.values()) < len(rows)
        elif name == "mixing to target weights":
            u = {r.doc_id: r.u for r in docs.select("doc_id", mixing._uniform(F.lit(17), "doc_id", mixing.text_mark(F.col("text"))).alias("u")).collect()}
            copies = brute_copies([(r[0], len(r[1].split()), r[3], u[r[0]]) for r in rows])
            expect = Counter({r: copies[r[0]] for r in rows if copies[r[0]]})
            assert len(set(copies.values())) > 1
        else:
            expect = Counter()
            for r in rows:
                ids = np.array([*library.encode(r[1], add_special_tokens=False).ids, 1], "<u4")
                for start in range(0, len(ids), 2048):
                    piece = ids[start : start + 2048]
                    expect[(r[0], start, len(piece), zlib.crc32(piece.tobytes()), len(ids))] += 1
            assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out.collect()) == expect
            break
        assert Counter(tuple(r) for r in out.select("doc_id", "text", "lang", "source").collect()) == expect, name
        assert all(r.n_chars is None or r.n_chars == len(r.text) for r in out.select("n_chars", "text").collect() if name != "quality rules")
        docs = out


def test_stages_take_clashing_names(spark):
    extra = ["gone_id", "gone_mark", "of_doc", "of_mark", "_mark", "mark", "text_mark", "own", "places", "n", "lang_"]
    good = " ".join(f"the river of word{i} and stone{i}" for i in range(60))
    rows = [(1, good, "en", "a", 1, *extra), (1, good, "en", "a", 1, *extra), (2, good + " x", "en", "b", 1, *extra), (3, "$$$ ### " * 90, "en", "b", 1, *extra)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{e} string" for e in extra))
    assert [r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, "").orderBy("doc_id").collect()] == [1, 1, 2]
    assert [r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").orderBy("doc_id").collect()] == [1, 3]
    kept = quality_rules.keep_quality(docs)
    assert kept.columns == docs.columns and all(tuple(r)[5:] == tuple(extra) for r in kept.collect())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() > 0, name
