import random

import corpus_pipeline
from latticeforge.llm import lines

SCHEMA = "doc_id long, text string, lines int, key string, gone int"


def brute(rows, run):
    """Kept texts; rows are distinct and in order of their id."""
    seen, gone = {}, {}
    for n, (_, text) in enumerate(rows):
        filled = [(i, x.strip(" \t\n\v\f\r")) for i, x in enumerate((text or "").split("\n"))]
        filled = [(i, x) for i, x in filled if x]
        for a in range(len(filled) - run + 1):
            part = filled[a : a + run]
            key = tuple(x for _, x in part)
            if key in seen:
                gone.setdefault(n, set()).update(i for i, _ in part)
            seen.setdefault(key, (n, a))
    return [text if n not in gone else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[n]) for n, (_, text) in enumerate(rows)]


def test_against_brute_force(spark):
    for seed, run in ((1, 3), (2, 1), (3, 2), (4, 5)):
        rng = random.Random(seed)
        some = [f"line {i}" for i in range(40)] + ["", " ", "x ", "x"]
        rows = [(i, "\n".join(rng.choice(some) for _ in range(rng.randint(0, 30)))) for i in range(40)]
        rows += [(40, None), (41, ""), (42, "same\n" * 500), (43, rows[3][1]), (44, "\n".join(f"long {i % 700}" for i in range(3000))), (45, "tail\n\n\n")]
        df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA).repartition(3)
        out = lines.deduplicate(df, run, removed="n")
        assert out.columns == [*df.columns, "n"]
        got = {r["doc_id"]: (r["text"], r["n"]) for r in out.collect()}
        want = brute(rows, run)
        assert [got[i][0] for i in range(len(rows))] == want
        for (i, text), left in zip(rows, want, strict=True):
            assert got[i][1] == (0 if text == left else len(text.split("\n")) - (len(left.split("\n")) if left or len(text.split("\n")) > got[i][1] else 0))


def test_null_and_repeated_ids(spark):
    text = "a\nb\nc\nd"
    df = spark.createDataFrame([(None, text, 1, "", 1), (7, text, 1, "", 1), (7, text, 1, "", 1), (8, "0\n" + text, 1, "", 1)], SCHEMA)
    got = sorted(((r["doc_id"], r["text"]) for r in lines.deduplicate(df).collect()), key=str)
    assert got == [(7, ""), (7, ""), (8, "0"), (None, text)]
    assert lines.deduplicate(df.limit(0)).collect() == []


def brute_by_content(rows, run, words):
    """Like brute, but shorter runs of ``words`` words or more count too."""
    seen, gone = set(), {}
    for n, (_, text) in enumerate(rows):
        filled = [(i, x.strip(" \t\n\v\f\r")) for i, x in enumerate((text or "").split("\n"))]
        filled = [(i, x) for i, x in filled if x]
        for size in range(1, run + 1):
            for a in range(len(filled) - size + 1):
                part = filled[a : a + size]
                key = tuple(x for _, x in part)
                if size < run and sum(len(x.split()) for x in key) < words:
                    continue
                if key in seen:
                    gone.setdefault(n, set()).update(i for i, _ in part)
                seen.add(key)
    return [text if n not in gone else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[n]) for n, (_, text) in enumerate(rows)]


def test_short_runs_of_many_words(spark):
    rng = random.Random(8)
    some = [" ".join(f"w{rng.randrange(50)}" for _ in range(n)) for n in (1, 2, 5, 11, 12, 13, 14, 24, 25, 26, 60) for _ in range(4)] + ["", " "]
    rows = [(i, "\n".join(rng.choice(some) for _ in range(rng.randint(1, 6)))) for i in range(60)] + [(60, some[-3]), (61, some[-3]), (62, None)]
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA).repartition(3)
    got = {r["doc_id"]: r["text"] for r in lines.deduplicate(df, words=25).collect()}
    want = brute_by_content(rows, 3, 25)
    assert [got[i] for i in range(len(rows))] == want != brute(rows, 3)
    assert got[61] == ""


def test_the_stage_deletes_a_long_line_that_repeats(spark):
    long = " ".join(f"word{i}" for i in range(168))
    df = spark.createDataFrame([(1, long, "en", "s", 0), (2, "Own line.\n" + long, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.dedup_lines(spark, df, "").collect()}
    assert got == {1: (long, 0), 2: ("Own line.", 9)}


def test_selection_decides(spark, monkeypatch):
    """Window minima are selected, each position once; another selection, which equal windows do not share, finds less."""
    text = "\n".join(f"line {i}" for i in range(60))
    rows = [(1, "alpha\n" + text), (2, "beta\ngamma\n" + text), (3, text + "\nomega")]
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA)
    parts = df.selectExpr("doc_id AS id", "hash(text) AS key", "text").withColumn("lines", lines._filled(df["text"])).drop("text").cache()
    got = lines.positions(parts, 3).collect()
    want = set()
    for r in parts.collect():
        h = [x["h"] for x in r["lines"]]
        want |= {(r["id"], max(range(i, i + 3), key=lambda k: (-h[k], k))) for i in range(len(h) - 2)}
    assert {(r["id"], r["line"]) for r in got} == want and len(got) == len(want) < 0.7 * sum(len(r["lines"]) for r in parts.collect())
    assert all(3 <= len(r["near"]) <= 5 and r["line"] in [x["i"] for x in r["near"]] for r in got)
    whole = [r["text"] for r in lines.deduplicate(df).orderBy("doc_id").collect()]
    assert whole == brute(rows, 3)
    monkeypatch.setattr(lines, "_selected", lambda start, run: start + (start + 1) % 2)  # by place, not by content
    assert [r["text"] for r in lines.deduplicate(df).orderBy("doc_id").collect()] != whole


def test_without_ansi(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        df = spark.createDataFrame([(1, None, 1, "k", 2), (2, "x", 1, "k", 2), (3, "a\nb\nc", 1, "k", 2), (4, "a\nb\nc", 1, "k", 2)], SCHEMA)
        assert {r["doc_id"]: r["n"] for r in lines.deduplicate(df, removed="n").collect()} == {1: 0, 2: 0, 3: 0, 4: 3}
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
