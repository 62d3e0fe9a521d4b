"""Every stage's decisions take effect, and the stages fit together."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from loomgraph.llm import mixing, neardup, pii
from loomgraph.llm.common import stored
from loomgraph.llm.queries import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(None, "call +1 (269) 555-3296 now " * 3, "en", None, 3), (900_001, None, None, None, None), (900_002, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    d = table(spark, SF, "documents")
    return stored(d.unionByName(odd).unionByName(d.filter("doc_id < 3")), "docs")


def test_stages(spark, docs):
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "near-duplicates", "personal data", "mixing", "tokens"]
    quality = table(spark, SF, "labels").select("doc_id", "quality")
    one = stored(cp.quality(spark, docs, SF), "one")
    assert one.columns == docs.columns and 0 < one.count() < docs.count()
    good = quality.filter("quality = 1").join(docs.filter("size(split(text, ' ')) >= 20"), "doc_id", "left_semi")
    assert good.join(one, "doc_id", "left_anti").count() <= 0.05 * good.count()
    two = stored(cp.near_duplicates(spark, one, SF), "two")
    groups = neardup.near_duplicates(one).filter("doc_id is not null")
    assert {r[0] for r in two.filter("doc_id is not null").select("doc_id").collect()} == {r[0] for r in groups.filter("kept").select("doc_id").collect()}
    assert two.groupBy("doc_id").count().filter("count > 1").isEmpty()
    three = stored(cp.personal_data(spark, two, SF), "three")
    assert three.count() == two.count() and pii.find_pii(three).filter(F.exists("pii", lambda x: x["kind"] == "email")).isEmpty()
    assert three.filter("text like '%[PHONE]%'").count() >= 1
    rows, parts = mixing.mix(three)
    four = stored(cp.mixed(spark, three, SF), "four")
    assert four.columns == docs.columns
    want = mixing.taken(rows, parts).agg(F.sum("taken")).first()[0]
    assert four.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == want
    five = cp.tokens(spark, four, SF)
    assert five.count() == four.count() and five.filter("n_tokens <> size(tokens)").isEmpty()
    match = five.join(four.select("doc_id", F.sha2("text", 256).alias("h")).distinct(), "doc_id").filter("h = decoded_sha256")
    assert match.select("doc_id").distinct().count() >= 0.99 * five.filter("doc_id is not null").select("doc_id").distinct().count()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs = empty
    for _, stage in cp.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), "empty")
        assert docs.columns == empty.columns and docs.count() == 0
    assert cp.tokens(spark, docs, SF).count() == 0


def test_near_duplicate_stage_compares_five_words(spark):
    """Four of 100 words changed, far apart: 2-word similarity 91 / 107, above 0.8; 5-word similarity 76 / 116."""
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words), " ".join(f"x{i}" if i in (20, 40, 60, 80) else w for i, w in enumerate(words)), " ".join(words[:-1])]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in cp.near_duplicates(spark, docs, SF).collect()} == {0, 1}
    assert {r["doc_id"] for r in neardup.near_duplicates(docs, neardup.Params(width=2)).filter("kept").collect()} == {0}


def test_texts_under_one_id_are_kept_apart(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a), (3, b + " end"), (4, "other words"), (4, "other words"), (None, b), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = [(r["doc_id"], r["text"]) for r in cp.near_duplicates(spark, docs, SF).collect()]
    assert sorted(t.split()[0] for _, t in out) == ["no", "other", "v0", "w0"]


def test_columns_of_any_name_pass_through(spark):
    """Columns whose names the stages use inside keep their values and types."""
    d = table(spark, SF, "documents")
    docs = stored(d.unionByName(d.limit(3)).withColumn("_key", F.concat(F.lit("k"), F.col("doc_id").cast("string"))).withColumn("hash", F.lit("h")).withColumn("row", F.lit("r")).withColumn("id", F.lit(1.5)), "named")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes and out.count() > 0 and out.filter("_key not like 'k%' or id <> 1.5").isEmpty()
