import corpus_pipeline
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from tabveil.llm.quality import classify
from tests.llm import test_decontam, test_jaccard, test_linededup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that each stage gets, and at last the result."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    for name, f in corpus_pipeline.STAGES:
        out.append(docs)
        f(spark, docs, SF).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
    return [*out, docs]


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_each_stage_against_brute_force(spark, stages):
    start, good, lines, single, clean, coded = stages
    assert all(s.columns == start.columns for s in stages[:-1])
    scores = classify(start, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert set(texts(good)) == {r.doc_id for r in scores if r.predicted} and texts(good).items() <= texts(start).items()
    want = test_linededup.brute(sorted(texts(good).items()), 150)
    assert texts(lines) == {i: t for i, (t, _, gone) in want.items() if not (gone and not t.strip(" "))}
    assert {r.doc_id: len(r.text) for r in lines.collect()} == {r.doc_id: r.n_chars for r in lines.collect()}
    assert set(texts(single)) == {c for _, _, c in test_jaccard.brute(sorted(texts(lines).items()))}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    words = {i: set(t.lower().split()) for i, t in items}
    near = [(d, t) for d, t in texts(single).items() if any(len(w & set(t.lower().split())) >= 0.7 * len(w) for w in words.values()) and len(t) < 4000]
    found = {d for d, *_ in test_decontam.brute(near, items)}
    gone = set(texts(single)) - set(texts(clean))
    assert found <= gone and (gone - found).isdisjoint(d for d, _ in near)
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    for r in coded.collect():
        assert r.ids == library.encode(texts(clean)[r.doc_id], add_special_tokens=False).ids and r.same and r.n_tokens == len(r.ids)
    assert coded.count() == clean.count() > 0


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in stages[-1].collect())


def test_rows_of_odd_kinds(spark):
    """Repeated and null ids, null, empty and long texts, and an empty table, through the stages that filter by text."""
    long = " ".join(f"word{n * n % 7919}" for n in range(60_000))
    t, u, v = ("some text of eight words that is here", "quite another text that no other row has at all", "a third one of some words, for the null")
    rows = [(1, t), (4, t), (4, u), (None, v), (5, None), (6, ""), (7, long), (8, long + " end"), (9, u + " x1 x2 x3 x4 x5"), (9, u + " x1 x2 x3 x4 x5")]
    start = spark.read.parquet(f"{SF}/documents.parquet")
    docs = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long").select(*[c for c in start.columns])
    got = corpus_pipeline.jaccard_join(spark, docs, SF)
    assert got.columns == docs.columns
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == sorted([(1, t), (4, u), (None, v), (5, None), (6, ""), (7, long), (9, u + " x1 x2 x3 x4 x5")], key=key)
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.decontaminate):
        assert stage(spark, docs, SF).columns == docs.columns and stage(spark, docs.limit(0), SF).count() == 0
    assert sum(r.doc_id is None for r in corpus_pipeline.decontaminate(spark, docs, SF).collect()) == 1
    assert corpus_pipeline.bpe_encode(spark, docs, SF).where("n_tokens = 0").count() == 2


def test_quality_judges_rows_not_ids(spark):
    """A bad text goes though another row of its id is good, and rows without an id are judged by their text."""
    scores = classify(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    all_texts = texts(spark.read.parquet(f"{SF}/documents.parquet"))
    best, worst = (all_texts[f(scores, key=lambda r: r.score).doc_id] for f in (max, min))
    start = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(1, best), (1, worst), (2, worst), (None, best), (None, worst), (3, best), (3, best), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long").select(*start.columns)
    # the classifier is fitted on labelled rows of what it gets, so the documents come along
    got = corpus_pipeline.quality_classifier(spark, start.unionByName(docs.withColumn("doc_id", docs.doc_id + 10**9)), SF)
    assert got.columns == start.columns
    new = [(r.doc_id and r.doc_id - 10**9, r.text) for r in got.where("doc_id IS NULL OR doc_id >= 1000000000").collect()]
    assert sorted(((i or 0, t) for i, t in new if t)) == sorted([(1, best), (0, best), (3, best), (3, best)])
    assert corpus_pipeline.quality_classifier(spark, docs.limit(0), SF).count() == 0
