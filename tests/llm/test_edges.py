"""Nulls, blanks, repeats, clashing columns and empty tables in every operator and pipeline stage."""

import gc
import sys
import tracemalloc
import types
import weakref
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import common, html_extract, line_dedup, media, mixing, nearest, ngram_join, packing, quality, substring_dedup, toxicity

LONG = " ".join(f"word{i % 97}x{i}" for i in range(3000))
ROWS = [
    (1, "one two three four five six", "en", "a", 27, "k", 1.0),
    (2, None, "en", "a", 0, "k", 1.0),
    (3, "", None, None, 0, None, None),
    (4, " \n\t ", "de", "b", 4, "k", 1.0),
    (5, "one two three four five six", "en", "a", 27, "k", 1.0),
    (5, "one two three four five six", "en", "a", 27, "k", 1.0),
    (6, LONG, "en", "b", len(LONG), "k", 1.0),
    (None, "no id here at all", "en", "b", 17, "k", 1.0),
    (7, "é ü   \U0001f600 x", "fr", "c", 9, "k", 1.0),
]
#: Names that the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_line_dedup(docs, none):
    got = line_dedup.deduplicated(docs)
    rows = by_id(got)
    assert got.columns == [*docs.columns, "lines", "lines_removed"] and got.count() == len(ROWS)
    assert rows[2]["text"] is None and rows[2]["lines"] == 0 and rows[3]["text"] == "" and rows[4]["text"] == " \n\t "
    assert rows[5]["text"] == "" and rows[1]["lines_removed"] == 0 and rows[None]["text"] == "no id here at all"
    assert line_dedup.deduplicated(none).count() == 0


def test_ngram_join(docs, none):
    got = ngram_join.near_duplicates(docs)
    rows = by_id(got)
    assert got.count() == len(ROWS) and rows[5]["component_id"] == 1 and rows[1]["n_shingles"] == 2
    assert rows[2]["n_shingles"] == rows[3]["n_shingles"] == rows[4]["n_shingles"] == 0 and rows[3]["component_id"] == 3
    assert rows[None]["component_id"] is None and rows[6]["component_id"] == 6
    assert ngram_join.near_duplicates(none).count() == 0


def test_ngram_join_long_strangers(spark, monkeypatch):
    """Long texts that share three quarters of their words are told apart before their texts are moved; a copy is found."""
    common_part = [f"c{j}" for j in range(1500)]
    texts = {i: common_part + [f"d{i}x{j}" for j in range(500)] for i in range(40)}
    texts[40] = texts[7][:-100] + [f"y{j}" for j in range(60)]
    some = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(4).cache()
    read, similar = spark.sparkContext.accumulator(0), ngram_join._similar

    def counted(batches):
        def seen():
            for b in batches:
                read.add(b.num_rows)
                yield b

        yield from similar(seen())

    monkeypatch.setattr(ngram_join, "_similar", counted)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(some).collect()}
    assert got == {i: 7 if i == 40 else i for i in texts}
    assert 0 < read.value <= 10


def test_wide_sketches():
    """Wide sketches of any two lengths differ in no more bits than the sets do."""
    rng = np.random.default_rng(5)
    for m, n, both in [(600, 600, 600), (513, 4000, 500), (1000, 1030, 950), (1024, 1025, 0), (70000, 60000, 59000)]:
        tokens = rng.integers(0, 1 << 63, m + n - both, dtype=np.uint64)
        p, q = ngram_join._wide(tokens[:m]), ngram_join._wide(tokens[m - both :])
        assert 8 * len(p) >= m and ngram_join._apart(p, q) == ngram_join._apart(q, p) <= m + n - 2 * both
    assert ngram_join._wide(tokens[:512]) is None and ngram_join._wide(tokens[:0]) is None


def test_substring_dedup(docs, none, spark):
    got = by_id(substring_dedup.remove_repeats(docs))
    assert got[6]["n_removed"] == 0 and got[6]["n_words"] == 3000 and got[2]["kept"] == "" and got[4]["n_words"] == 0
    again = docs.union(spark.createDataFrame([(8, "lead in " + LONG[:900] + " tail", "en", "a", 0, "k", 1.0)], SCHEMA))
    rows = by_id(substring_dedup.remove_repeats(again))
    assert rows[8]["kept"].startswith("lead in") and rows[8]["kept"].endswith("tail") and rows[8]["n_removed"] > 50
    assert substring_dedup.remove_repeats(none).count() == 0


def test_mixing(docs, none):
    got = mixing.counted(docs).collect()
    assert len(got) == len(ROWS) and all(r["taken"] <= 3 * r["size"] for r in got)
    assert sum(r["size"] for r in got) == 6 * 3 + 3000 + 5 + 5
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and all(r["text"] for r in mixed.collect())
    assert mixing.counted(none).count() == 0 and mixing.mixed(none).count() == 0


def test_mixing_keeps_rows_apart(spark):
    """Every row keeps the words that the mix takes of it, with a null id, a repeated id or a twin."""
    texts = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, " ".join(f"r{k}w{j}" for j in range(40 + 13 * k % 70))) for k in range(60)]
    rows = [(i, t, "en", "ab"[k % 2], len(t)) for k, (i, t) in enumerate(texts)] + [(None, "twin " * 90, "en", "a", 450), (7, "twin " * 90, "en", "a", 450)] * 2
    some = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    counted = sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in mixing.counted(some).collect() if r["taken"])
    mixed = mixing.mixed(some).collect()
    assert sorted((r["doc_id"] or -1, len(r["text"].split())) for r in mixed) == sorted((i, n) for i, _, n in counted)
    whose = {r[1].split()[0].split("w")[0]: r for r in rows[:60]}
    for r in mixed:
        marks = {w.split("w")[0] for w in r["text"].split()}
        assert len(marks) == 1 and r["n_chars"] == len(r["text"])
        if marks != {"t"}:
            own = whose[marks.pop()]
            assert (r["doc_id"], r["source"]) == (own[0], own[3]) and set(r["text"].split()) <= set(own[1].split())
    assert sum(r["doc_id"] is None for r in mixed) > 5 and len({r["text"] for r in mixed if r["doc_id"] == 7}) > 5


def test_packing(docs, none):
    pieces = packing.pack(docs).collect()
    assert {r["doc_id"] for r in pieces} == {r[0] for r in ROWS}
    for doc in (1, 2, 6):
        own = sorted((r["start"], r["length"]) for r in pieces if r["doc_id"] == doc)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
    at = {}
    for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0) and len(r["ids"]) == 4 * r["length"]
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 1024 and packing.pack(none).count() == 0


def test_packing_memory():
    """A worker's words stay within a bound, those of every batch are encoded once alone, and ids are the tokenizer's own."""
    import public_tokenizers

    words, learnt = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), most=4_000_000), []
    learn, often, most = words._learn, "often met anew", 0
    words._learn = lambda todo: (learnt.extend(x for x in todo if x == "met"), learn(todo))
    for k in range(16):
        texts = [f"{often} " + " ".join(f"w{k:x}q{j:x}" for j in range(i, i + 500)) for i in range(0, 10_000, 500)]
        got = words.encode(texts)
        assert got[-1] == words._single(texts[-1:])[0]
        halves = (words.memo, words.old)
        most = max(most, sum(sys.getsizeof(h) + sum(map(sys.getsizeof, h)) + sum(map(sys.getsizeof, h.values())) for h in halves))
    assert most < 20_000_000 and learnt == ["met"]


def test_packing_plain_words():
    """Only odd words reach the tokenizer one by one; the others are merged in arrays, to the tokenizer's own ids."""
    import public_tokenizers

    words, alone = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json")), []
    tokenizer = words.tokenizer
    words.tokenizer = types.SimpleNamespace(encode_batch_fast=lambda units, **k: (alone.extend(units), tokenizer.encode_batch_fast(units, **k))[1])
    rng = np.random.default_rng(9)
    letters = {"plain": list("abcdehinorstuéñßЖ0189.,!?-(&_中́"), "odd": [*map(chr, [1, 9, 11, 28, 39, 133, 160, 0x180E, 0x200B, 0x3000, 0xE000, 0x1F600])]}
    made = {k: ["".join(rng.choice(x, n)) for n in rng.integers(1, 40, 3000)] for k, x in letters.items()}
    made["plain"] += ["an.\nEr", "a" * 64, "=" * 63, "²½", "x\ty", "anananan"]
    made["odd"] += ["", "it's", "a\n\nb", "a" * 65, "x" * 5000, "tail\n", "\thead", "a<|endoftext|>'b"]
    for kind, some in made.items():
        alone.clear()
        some = list(dict.fromkeys(some))
        words.memo.clear()
        words.encode(["head " + " ".join(some[i : i + 100]) + " tail" for i in range(0, len(some), 100)])
        assert alone == ["head"] or kind == "odd"
        words._learn([x for x in some if x not in words.memo])
        ids = [got.ids for got in tokenizer.encode_batch_fast([" " + x for x in some], add_special_tokens=False)]
        assert [words.memo[x] for x in some] == [np.array(x, "<u4").tobytes() for x in ids]


def test_packing_other_tokenizers(tmp_path):
    """Words go to the tokenizer where it does more than split, map bytes and merge; pairs written as one string are read too."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    text = "Some plain words, and Others. they come  twice"
    for name, change in {"same": {}, "pairs": {"merges": [" ".join(m) for m in spec["model"]["merges"]]}, "whole": {"ignore_merges": True}}.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(spec | {"model": spec["model"] | change}), encoding="utf-8")
        own = packing.Encoder(str(path))
        assert (own.merges is None) == (name == "whole") and own.encode([text]) == own._single([text])


def test_packing_forgotten():
    """A worker that turns to another operator gives up what packing has left in it; packing's own tasks go on with it."""
    import public_tokenizers

    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["one two three four five six"]})
    path = public_tokenizers.path("byte_bpe_50k.json")
    left = weakref.ref(packing.encoder(path))
    assert list(common.chunks([batch], remember=True)) and packing.encoder(path) is left()
    for other in (ngram_join._describe, ngram_join._repeated, quality._with_features):
        left = weakref.ref(packing.encoder(path))
        list(other([batch]))
        gc.collect()
        assert left() is None, other


def test_repeated_shingles(monkeypatch):
    """Repeated shingles are counted in little more than a block, also those of a set that is longer than a block."""
    monkeypatch.setattr(ngram_join, "_fresh_sets", lambda sets: ((i, s) for i, s in enumerate(sets)))
    monkeypatch.setattr(ngram_join, "TOKENS", 1 << 18)
    few = [np.arange(10, dtype=np.uint64) * (k + 1) for k in range(4)] + [np.array([1 << 63, (1 << 64) - 1], np.uint64)] * 3
    got = [dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())) for b in ngram_join._repeated(few)]
    want = Counter(x for s in few for x in s.view(np.int64).tolist())
    assert got == [{k: n for k, n in want.items() if n > 1}]

    twice, long = np.arange(1 << 16, dtype=np.uint64), np.arange(3 << 18, dtype=np.uint64)
    tracemalloc.start()
    rows = [b.num_rows for b in ngram_join._repeated(iter([twice, long, twice]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == [1 << 16, 0, 0, 0] and peak < 20 * (1 << 18), peak


def test_media(docs, none):
    rows = by_id(media.features(media.stored(docs)))
    assert len(rows[3]["payload"]) == 192 and rows[2]["feature"] == rows[3]["feature"] and rows[6]["payload"].decode().rstrip(" ") == LONG
    assert rows[1]["feature"] == rows[5]["feature"] and media.features(media.stored(none)).count() == 0


def test_classifiers(docs, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 1), (6, 0, 1), (None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        for some in (labels, empty):
            got = module.scored(docs, module.fit(docs, some)).collect()
            assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
        assert module.scored(none, module.fit(none, empty)).count() == 0


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>x"), (4, "u", "<" * 500 + "&bad; &amp"), (4, "u", "<div>" * 5000 + "deep")], "page_id long, url string, html string")
    got = [r["text"] for r in html_extract.extracted(pages.withColumn("text", pages["url"])).collect()]
    assert got[:3] == ["", "", "x"] and got[4] == "deep" and html_extract.extracted(pages.limit(0)).count() == 0


def test_nearest(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0], 0) for i in range(0, 130)] + [(130, None, 0), (131, [0.0, 0.0, 0.0], 0), (200, [float("nan"), 1.0, 1.0], 0), (300, [1.0], 0), (None, [1.0, 2.0, 3.0], 0), (100, [2.0, 0.0, 1.0], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int")
    got = nearest.neighbours(vectors).collect()
    assert {r["query_id"] for r in got} == {0, 100} and all(r["vec_id"] != r["query_id"] for r in got) and len(got) == 20
    first = sorted((r["rank"], r["score"], r["vec_id"]) for r in got if r["query_id"] == 0)
    assert first[0][1:] == (0.0, 35) and [x[1] for x in first] == sorted(x[1] for x in first)
    assert nearest.neighbours(vectors.limit(0)).count() == 0


def test_stages(docs, none, spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = ["gone", "gone_id", "mixed_id", "row", "one", "slot", "pieces"]
    for table in (docs, none):
        rows = table.select("doc_id", "text", "lang", "source", "n_chars")
        for k, name in enumerate(names):
            rows = rows.withColumn(name, F.lit(k))
        before = rows.collect()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, str(tmp_path))
            got = out.collect()
            if name != "packing":
                assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", *names], name
                assert all(r[n] == k for r in got for k, n in enumerate(names)), name
            ids = sorted(str(r["doc_id"]) for r in got)
            every = sorted(str(r["doc_id"]) for r in before)
            if name in ("quality classifier", "line dedup"):  # too few labels to judge by: all stay
                assert ids == every, name
            elif name == "near duplicates":
                assert ids == [x for x in every if x != "5"] and sorted(map(str, got)) == sorted(str(r) for r in before if r["doc_id"] != 5)
            elif name == "mixing":
                assert set(ids) <= set(every) and all(set(r["text"].split()) <= {w for b in before if b["doc_id"] == r["doc_id"] for w in (b["text"] or "").split()} for r in got)
            else:
                assert set(ids) == set(every)


def test_line_dedup_names(spark):
    """Columns with the names that the operator uses keep their values; lines and lines_removed are the operator's."""
    rows = [(1, "a b c d e\nx", 1, 2, 3, 4), (2, "a b c d e\ny", 5, 6, 7, 8), (2, "y\nz", 9, 9, 9, 9)]
    some = spark.createDataFrame(rows, "doc_id long, text string, gone int, gone_id int, lines int, `row` int")
    got = sorted((r["doc_id"], r["text"], r["gone"], r["gone_id"], r["row"], r["lines"], r["lines_removed"]) for r in line_dedup.deduplicated(some).collect())
    assert got == [(1, "a b c d e\nx", 1, 2, 4, 2, 0), (2, "", 5, 6, 8, 2, 2), (2, "y\nz", 9, 9, 9, 2, 0)]


def test_line_dedup_order(spark, monkeypatch):
    """Sets of words are sorted as longs, not as objects, and whatever documents are counted, the same lines go."""
    rows = [(i, "\n".join(" ".join(f"w{(7 * i + 3 * j + k * k) % 41}" for k in range(4 + j)) for j in range(12)) + "\n \n\t\r\n a  b\tc") for i in range(60)]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    assert '"containsNull":false' in line_dedup._described(some).select("prefix").schema.json()
    got = []
    for every in (1, 8, 1 << 40):
        monkeypatch.setattr(line_dedup, "COUNTED", every)
        got.append(sorted(map(tuple, line_dedup.deduplicated(some).collect())))
    assert got[0] == got[1] == got[2] and 0 < sum(r[3] for r in got[0]) < sum(r[2] for r in got[0])


def test_mixing_plan(spark, docs):
    """The plan of a mix reaches the executors without Python workers of a second kind."""
    assert "PythonRDD" not in mixing.Mix(docs).slots._jdf.queryExecution().toRdd().toDebugString()
    some = common.small(spark, [("a", 1, 0.5), ("b\U0001f600", None, 2.0)], "name string, n long, x double")
    assert [tuple(r) for r in some.collect()] == [("a", 1, 0.5), ("b\U0001f600", None, 2.0)]
    assert common.small(spark, [], "n long").count() == 0


def test_shared_folder():
    """Without a shared folder a session on a cluster gets an error, never a folder of the driver's own."""
    context = types.SimpleNamespace(getCheckpointDir=lambda: None, master="spark://x:7077")
    with pytest.raises(ValueError):
        common.shared_dir(types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d: d), sparkContext=context))
