import random

import corpus_pipeline
from latticeforge.llm import decontamination, toxicity

from . import test_lines, test_mixing, test_shingles, test_simhash


def tables(spark, folder, seed=5):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "abcdef" for b in "uvwxyz" for c in "ghijkl"]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(4, 14)))
    items = [" ".join(rng.choice(words) for _ in range(20)) for _ in range(5)]
    block = [line() for _ in range(4)]
    docs, labels = [], []
    for i in range(240):
        text = [line() for _ in range(rng.randint(1, 9))]
        toxic = int(i % 5 == 1)
        if toxic:
            text[0] = "vexum " + text[0] + " grimbo vexum trolt"
        if i % 11 == 3:
            text += block
        if i % 13 == 4:
            text.append(items[i % 5])
        if docs and i % 9 == 5:
            text = docs[rng.randrange(len(docs))][1].split("\n")
        if docs and i % 17 == 6:  # a near copy: words joined to other lines, one changed
            text = docs[rng.randrange(len(docs))][1].replace("\n", " ").split(" ")
            text = [" ".join([*text[:-1], rng.choice(words)])]
        docs.append((i, "\n".join(text), "en", f"s{i % 4}", 0))
        labels.append((i, 1, toxic))
    docs += [(300, None, None, None, None), (301, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def test_against_brute_force(spark, tmp_path):
    docs, items = tables(spark, tmp_path)
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}.parquet")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(read("documents"), read("labels")).collect()}
    left = [d for d in docs if scores[d[0]] < 0.5]
    assert 20 < len(docs) - len(left) < 80
    texts = dict(zip([d[0] for d in left], test_lines.brute_by_content([(d[0], d[1]) for d in left], 3, 25), strict=True))
    sets = {i: test_shingles.brute_set(t) for i, t in texts.items()}
    roots = test_simhash.brute_components(list(texts), lambda a, b: test_shingles.alike(sets[a], sets[b]))
    kept = [i for i in texts if roots[i] == i]
    bench = [decontamination.words_of(t) for t in items]

    def leaks(text):
        words = decontamination.words_of(text)
        tiled = lambda b: sum(n for _, _, n in decontamination.tiles([*map(hash, b)], [*map(hash, words)]))
        return any(tiled(b) >= decontamination.COVERED * len(b) for b in bench)

    kept = [i for i in kept if not leaks(texts[i])]
    assert sorted(got) == sorted(kept)
    source = {d[0]: d[3] for d in docs}
    sizes = {}
    for i in kept:
        assert got[i]["size"] == len((texts[i] or "").split())
        sizes[source[i]] = sizes.get(source[i], 0) + got[i]["size"]
    want = test_mixing.brute_targets(sizes)
    for s, target in want.items():
        rows = [got[i] for i in kept if source[i] == s]
        assert all(abs(r["target"] - target) < 1e-6 * max(1, target) for r in rows)
        assert abs(sum(r["taken"] for r in rows) - target) <= 1.001


def test_columns_and_empty_tables(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), str(tmp_path))
        assert out.dtypes == docs.dtypes and out.count() == 0


def test_empty_corpus(spark, tmp_path):
    tables(spark, tmp_path / "full")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/full/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
