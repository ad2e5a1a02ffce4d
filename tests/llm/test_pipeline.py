import random

import pytest

import corpus_pipeline
from keystrata.llm import language, mixing
from pyspark.sql import functions as F

from test_decontaminate import brute as brute_hits
from test_mixing import brute as brute_mix, many_texts, topics_of_all
from test_ngram_join import brute as brute_near

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture
def folder(spark, docs, tmp_path):
    rng = random.Random(11)
    pool = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, text(rng.randint(8, 30))) for i in range(6)]
    rows = [(i, text(rng.randint(1, 80)), rng.choice(["en", "de"]), rng.choice("ab")) for i in range(60)]
    rows += [(100 + i, rows[i][1] if i % 2 else rows[i][1] + " tail", "en", "a") for i in range(20)]
    rows += [(200 + i, f"{text(20)} {items[i % 6][1]} {text(10)}", "en", "b") for i in range(10)] + [(300, None, "en", "a"), (301, "12 34", "en", "a"), (302, "", None, None)]
    docs(*rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows, items


def test_run_against_brute_force(spark, docs, folder):
    from tokenizers import Tokenizer

    path, rows, items = folder
    every = spark.read.parquet(f"{path}/documents.parquet")
    model = language.fit(every.withColumn("mark", F.xxhash64("text")), key="mark")
    langs = {r["doc_id"]: r["lang_pred"] for r in language.predict(every, model).collect()}
    texts = {r[0]: r[1] for r in rows if r[1] and any(c.isalpha() for c in r[1])}
    assert {i for i in langs if langs[i] != "und"} == set(texts)
    near = brute_near(list(texts.items()), 5, 80)
    texts = {i: t for i, t in texts.items() if near[i][1] == i}
    hits = brute_hits(list(texts.items()), items)
    texts = {i: t for i, t in texts.items() if not hits[i][2]}
    assert not set(range(200, 210)) & set(texts) and len(texts) > 40
    source = {r[0]: r[3] for r in rows}
    left = [(i, t, langs[i], source[i]) for i, t in texts.items()]
    kept = {x[0] for x in brute_mix(left, mixing.fit_topics(docs(*left))) if x[6]}
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    at, want = 0, {}
    for i in sorted(kept):
        n = len(encode(texts[i], add_special_tokens=False).ids) + 1
        want[i], at = (at, n), at + n
    assert {r["doc_id"]: (r["start"], r["n_tokens"]) for r in corpus_pipeline.run(spark, path).collect()} == want


def test_stages_keep_the_columns(spark, folder):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and 0 < out.count() < len(rows)


def test_repeated_rows_leave_one(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").filter("doc_id < 3")
    twice = docs.unionByName(docs)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, twice, path).collect()) == [0, 1, 2]


def test_empty_documents(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0


def test_rows_are_dropped_by_row(spark, folder, docs):
    """Neither a null doc_id nor one on many texts shields a row or drops its neighbours."""
    path, _, items = folder
    base = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100, 160)]
    one, near, other, third = " ".join(base), " ".join(["new", *base[1:]]), " ".join(reversed(base)), " ".join(base[::2])
    left = lambda stage, *rows: sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs(*((i, x, "en", "a") for i, x in rows)), path).collect()), key=str)
    want = lambda *rows: sorted(rows, key=str)
    for i in (None, 7):
        assert left(corpus_pipeline.identify_language, (i, None), (i, "12 34"), (i, one), (i, other), (3, third)) == want((i, one), (i, other), (3, third))
        assert left(corpus_pipeline.drop_near_copies, (i, one), (i, one), (9, near), (i, other), (i, third), (i, third), (i, " "), (i, " "), (i, None), (i, None)) == want(
            (i or 9, one if i else near), (i, other), (i, third), (i, " "), (i, None))
        assert left(corpus_pipeline.drop_benchmark, (i, items[0][1]), (i, one), (i, other)) == want((i, one), (i, other))
    assert len(left(corpus_pipeline.drop_near_copies, (None, one), (None, near), (None, one))) == 1


def test_mixing_draws_by_row(spark, folder, docs):
    path, _, _ = folder
    rows = [(i, f"text {'long ' * (n % 7)}{n}", "en" if n % 3 else "de", "a" if n % 5 else "b") for n in range(300) for i in (None, 7)]
    kept = corpus_pipeline.mix_sources(spark, docs(*rows), path).groupBy("doc_id", "source", "lang").count().collect()
    held = {(i, s, x): sum(1 for r in rows if (r[0], r[3], r[2]) == (i, s, x)) for i, _, x, s in rows}
    assert {r["doc_id"] for r in kept} == {None, 7} and any(0 < r["count"] < held[r["doc_id"], r["source"], r["lang"]] for r in kept)


def test_the_model_decides_the_language(spark, folder, docs):
    path, _, _ = folder
    got = lambda *rows: sorted((r["doc_id"], r["lang"]) for r in corpus_pipeline.identify_language(spark, docs(*rows), path).collect())
    assert got((1, "words but no label"), (2, "12 34"), (3, None)) == [(1, None)]
    de, en = "der fluss und der berg", "the river and the hill"
    rows = [(i, f"{de if i % 2 else en} {'xy'[i // 2 % 2] * (i + 1)}", "de" if i % 2 else "en") for i in range(12)]
    found = dict(got(*rows, (20, "der berg"), (21, "the hill"), (22, "12", "en"), (23, "der fluss und der berg heute", "en")))
    assert found == {i: "de" if i % 2 else "en" for i in range(12)} | {20: "de", 21: "en", 23: "de"}


def test_predicted_languages_are_mixed(spark, docs):
    """Wrong labels of the mixing stage's input would change the cells, so the output follows the model."""
    rows = [(i, f"text {'long ' * (i % 7)}{i}", "en" if i % 3 else "de", "a" if i % 5 else "b") for i in range(300)]
    one, other = (sorted(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs(*x), "").collect()) for x in (rows, [(*r[:2], "en", r[3]) for r in rows]))
    assert one != other


def test_further_columns_and_long_texts(spark, folder, docs):
    path, _, _ = folder
    extra = docs((1, "some words of a short text", "en", "a"), (2, "very long words " * 500_000, "en", "a")).withColumn("content", F.lit("c")).withColumn("kept", F.lit(1)).withColumn("component_id", F.lit(2)).withColumn("stage_row", F.lit(3))
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, extra, path)
        assert out.columns == extra.columns and sorted(r["doc_id"] for r in out.select("doc_id").collect()) == [1, 2]
    assert corpus_pipeline.mix_sources(spark, extra, path).columns == extra.columns


def test_mixing_learns_from_every_text(spark, docs):
    """The stage's topics are those of all its texts, more than a sample of 4,096 would hold."""
    texts = many_texts(5000)
    rows = [(i, t, "en" if i % 3 else "de", "a" if i % 4 else "b") for i, t in enumerate(texts)]
    weights, centres = topics_of_all([t or "" for t in texts])
    want = sorted(x[0] for x in brute_mix(rows, mixing.Topics(weights, (centres * mixing.Topics.PARTS).round())) if x[6])
    assert sorted(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs(*rows), "").collect()) == want
