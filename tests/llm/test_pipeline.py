from pyspark.sql import functions as F

import corpus_pipeline
from trialframe.llm.queries import QUERIES
from trialframe.llm.store import save

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_columns_and_only_drop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10_000, None, None, None, None), (10_001, "", "en", "src0", 0), (None, "some words of no id at all", "en", "src1", 5)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.where("doc_id = 1"))
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = save(stage(spark, docs, SF), "stage")
        assert docs.columns == COLUMNS
        assert 0 < docs.count() <= before, name
        before = docs.count()
    ids = [r[0] for r in docs.where("doc_id is not null").select("doc_id").collect()]
    assert len(ids) == len(set(ids))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_empty_tables_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_stage_names_and_queries():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    assert [k.split("_")[0] for k in QUERIES] == [f"op{n}" for n in range(1, 14)]


def test_near_copies_leave_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (3, text), (3, text), (9, text.replace("w30", "other")), (4, " ".join(f"v{i}" for i in range(60)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [3, 4]


def test_near_copies_of_repeated_ids_are_rows(spark):
    def text(c):
        return " ".join(f"{c}{i}" for i in range(60))

    # id 2 has a copy of id 1 and a text of its own; id 3 two texts; id 4 equal rows that differ in another column
    rows = [(1, text("a"), "en"), (2, text("a").replace("a30", "other"), "en"), (2, text("b"), "en"), (3, text("c"), "en"), (3, text("d"), "en"), (3, text("c").upper(), "en"), (4, text("e"), "en"), (4, text("e"), "de"), (None, text("a"), "en"), (5, text("d"), "en"), (6, "", "en"), (6, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for _ in range(2):
        left = corpus_pipeline.drop_near_copies(spark, docs.repartition(5), SF)
        got = sorted((r["doc_id"] or 0, r["text"].lower()[:1], r["lang"]) for r in left.collect())
        assert left.columns == docs.columns
        assert got == [(0, "a", "en"), (1, "a", "en"), (2, "b", "en"), (3, "c", "en"), (3, "d", "en"), (4, "e", "de"), (6, "", "en")]


def test_stages_leave_every_column_of_the_caller(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long, evidence double, toxicity double, quality_score string, key int, rest int, _host string, host int, n int, x string, component_id int"
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(i, text("abc"[i % 3] if i < 6 else "zyx"[i % 3] + str(i)), "en", "s", 9, 0.25, 0.5, "q", i, -i, "h", 3, 4, "x", 7) for i in range(30)]
    rows += [rows[0], (None, None, None, None, None, 0.25, 0.5, "q", 1, 2, "h", 3, 4, "x", 7), (40, "", "en", "s", 0, 0.25, 0.5, "q", 1, 2, "h", 3, 4, "x", 7), (41, "long " * 100_000, "en", "s", 0, 0.25, 0.5, "q", 1, 2, "h", 3, 4, "x", 7)]
    docs = spark.createDataFrame(rows, names)
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for given in (docs, docs.dropDuplicates(["doc_id"])):
            out = stage(spark, given, SF)
            assert out.columns == docs.columns
            left[name] = out.collect()
            assert {tuple(r) for r in left[name]} <= set(rows)
    assert sorted(r["doc_id"] for r in left["n-gram Jaccard join"] if r["doc_id"] is not None)[:5] == [0, 1, 2, 6, 7]
    packed = corpus_pipeline.pack(spark, docs, SF).collect()
    assert len({r["doc_id"] for r in packed}) == len({r[0] for r in rows})


def test_pipeline_against_brute_force(spark):
    """The rows that each stage keeps, by the plain versions of the operators' tests."""
    from tests.llm.test_ngram_join import brute
    from tests.llm.test_text_operators import brute_quality, brute_toxicity
    from trialframe.llm import decontaminate as dc
    from trialframe.llm.queries import GOOD, TOXIC

    label = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    score, _, _ = brute_toxicity([(i, t, label[i]["toxic"] if i in label else None) for i, t, _, _ in docs])
    docs = [d for d in docs if score[d[0]] < TOXIC]
    rows = [(*d, label[d[0]]["quality"] if d[0] in label else None) for d in docs]
    good = brute_quality(rows, rows)
    docs = [d for i, d in enumerate(docs) if good[i] >= GOOD]
    component = brute([(i, t) for i, t, _, _ in docs], 5, 80)
    docs = [d for d, (c, _) in zip(docs, component) if c == d[0]]
    items = [tuple(dc.plain_words(dc.text_column(dc.pa.array([r["text"]])))[0].tolist()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(text):
        w = dc.plain_words(dc.text_column(dc.pa.array([text or ""])))[0].tolist()
        for t in items:
            for shift in range(-len(t) + 1, len(w)):
                low, high = max(0, shift), min(len(w), shift + len(t))
                equal = [w[i] == t[i - shift] for i in range(low, high)]
                if 5 * sum(equal) >= 4 * min(13, len(t)):
                    hits = [i for i, e in enumerate(equal) if e]
                    if any(b - a + 1 >= min(13, len(t)) and 5 * sum(equal[a : b + 1]) >= 4 * (b - a + 1) for a in hits for b in hits if b >= a):
                        return True
        return False

    want = {d[0] for d in docs if not leaks(d[1])}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        assert sorted(parts)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:])) and sum(n for _, n in parts) <= 2048
