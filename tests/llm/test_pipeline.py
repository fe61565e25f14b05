"""The pipeline's run() on a small table against a plain restatement of each stage."""

import collections

import numpy as np

import corpus_pipeline
from seqloom.llm import mixing, quality

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return collections.Counter((r["doc_id"], r["source"], r["text"]) for r in df.collect())


def lines_left(rows):
    holds, sizes, got = collections.defaultdict(list), [], {}
    for k, text in sorted({(k, t) for k, _, t in rows if k is not None and t is not None}):
        left = []
        for line in text.split("\n"):
            w = frozenset(line.encode().split())
            both = collections.Counter(i for x in w for i in holds[x])
            if not any(5 * n >= 4 * (len(w) + sizes[i] - n) for i, n in both.items()):
                left.append(line)
            for x in w:
                holds[x].append(len(sizes))
            sizes.append(len(w))
        got[k] = "\n".join(left)
    return collections.Counter({(k, s, t if k is None else got.get(k)): n for (k, s, t), n in rows.items()})


def copies_left(rows):
    sets, root = {}, {}
    for k, _, text in rows:
        w = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
        if k is not None:
            sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
            root[k] = k
    for a in sorted(sets):
        for b in sets:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return collections.Counter({r: n for r, n in rows.items() if r[0] is None or root[r[0]] == r[0]})


def test_run(spark, tmp_path, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.orderBy("doc_id").limit(12)
    docs = docs.unionByName(first.withColumn("doc_id", docs["doc_id"] * 0 - 1).selectExpr("nullif(doc_id, -1) doc_id", "concat('null id ', text) text", "lang", "source", "n_chars")).unionByName(first.limit(3))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    stages, kept = {}, corpus_pipeline.common.kept

    def seen(df, name, **options):
        out = kept(df, name, **options)
        if name.startswith("stage-"):
            stages[name] = out
        return out

    monkeypatch.setattr(corpus_pipeline.common, "kept", seen)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = [rows_of(stages[f"stage-{n}"]) for n in ("quality-classifier", "line-dedup", "near-duplicates", "mixing")]

    model = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    texts = docs.where("text is not null").collect()
    good = [r for r in texts if model.score(quality.features(spark_text(r["text"])))[0] >= quality.PREDICT_FROM]
    assert after[0] == collections.Counter((r["doc_id"], r["source"], r["text"]) for r in good) and 0 < len(good) <= len(texts)
    assert after[1] == lines_left(after[0])
    assert after[2] == copies_left(after[1])

    had, size, got = collections.defaultdict(set), collections.Counter(), collections.Counter()
    for (k, s, t), n in after[2].items():
        had[k, s] |= set((t or "").split())
        size[s] += n * len((t or "").encode().split())
    for (k, s, t), n in after[3].items():
        assert set(t.split()) <= had[k, s]
        got[s] += n * len(t.encode().split())
    names = sorted(size, key=lambda x: (x is None, x))
    for s, target in zip(names, mixing.targets([size[s] for s in names])):
        assert abs(got[s] - target) <= 2 * mixing.BLOCK + 0.02 * target
    assert any(k is None for k, _, _ in after[3])

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want, pieces = collections.Counter(), collections.defaultdict(list)
    for (k, _, t), n in after[3].items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.update({(k, int(x)): n * int(c) for x, c in zip(*np.unique(ids, return_counts=True))})
    found, at = collections.Counter(), {}
    for r in packed:
        found.update((r["doc_id"], x) for x in np.frombuffer(bytes(r["ids"]), "<u4").tolist())
        pieces[r["sequence_id"]].append((r["offset"], r["length"]))
    assert found == want
    for own in pieces.values():
        at = np.cumsum([0] + [n for _, n in sorted(own)])
        assert [a for a, _ in sorted(own)] == at[:-1].tolist() and at[-1] <= 1024


def spark_text(text):
    import pyarrow as pa

    return pa.array([text], pa.string())
