"""The pipeline's stages against plain versions on the small tables."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as cp
from lodestrand.llm import secrets
from tests.llm.test_similar import plain_kept
from tests.llm.test_small_ops import SF, odd_docs, plain_base


def test_stages_on_the_small_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality rules", "near duplicates", "benchmark decontamination", "secret scan", "source mix"]
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in cp.STAGES[:4]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality rules":
            assert 0.5 * len(before) < len(after) < len(before)
        elif name == "near duplicates":
            assert set(after) == plain_kept(before)[0]
        elif name == "benchmark decontamination":
            gone = set(before) - set(after)
            held = {i for i, t in before.items() if any(x in " ".join(t.split()) for x in items)}
            assert held and held <= gone and len(gone - held) <= len(held)
        else:
            assert after.keys() == before.keys()
            assert all(not plain_base(t) for t in after.values())
            assert all(after[i] == before[i] for i in after if not plain_base(before[i]) and not re.search("eyJ|MII", before[i]))
        before = after
    rows = cp.mix(spark, docs, SF).collect()
    assert rows and {r.doc_id for r in rows} <= set(before) and all(0 < r.taken <= 3 * r.size for r in rows)
    assert all(r.text == before[r.doc_id] and r.epochs * r.size + r.rest_words == r.taken for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) < 1.001


def test_stages_of_odd_rows(spark):
    texts = [None, "", "w " * 30, "token=abcdef " + " ".join(map(str, range(40))), " ".join(map(str, range(40))), " ".join(map(str, range(40))), "x"]
    df = odd_docs(spark, texts, [0, 1, 2, 3, None, 5, 5])
    for _, stage in cp.STAGES[:4]:
        assert stage(spark, df, SF).columns == df.columns
        assert stage(spark, df.limit(0), SF).collect() == []
    assert cp.mix(spark, df.limit(0), SF).collect() == []
    mixed = cp.mix(spark, df, SF).collect()
    assert len(mixed) == len({(r.doc_id, r.text) for r in mixed}) and all(r.text and r.taken > 0 for r in mixed)
    kept = cp.near_duplicates(spark, df, SF).collect()
    assert sum(r.doc_id is None for r in kept) == 1 and sum(r.doc_id == 5 for r in kept) == 1
    assert secrets.redact("ab", "hex:0:1,hex:0:2") == "[SECRET]"


def test_stages_leave_columns_of_any_name_alone(spark):
    names = ["_row", "_set", "_print", "_keys", "_t", "_w", "_h1", "kept", "llr", "doc", "key", "fp", "rep", "_k", "_part", "taken", "epochs", "root", "node"]
    texts = [" ".join(f"word{i * j % 89}" for j in range(40)) for i in range(1, 7)] * 2
    rows = [(i, t, f"s{i % 2}", len(t), *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in cp.STAGES[:4]:
        got = {r.doc_id: r for r in stage(spark, df, SF).collect()}
        assert got and all(tuple(got[i]) == rows[i] for i in got), name
    mixed = cp.mix(spark, df, SF).collect()
    assert all(r._row == f"_row{r.doc_id}" and r._part == f"_part{r.doc_id}" and r.taken > 0 for r in mixed)


def test_quality_stage_trusts_every_row_that_is_labelled_good(spark, tmp_path):
    n = 5_500
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.concat_ws("x", "id", k)), " ").alias("text"))
    docs.select("doc_id", F.lit(1).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    # All are trusted, so no ratio is low; of a model from 5,000 rows the words of the rest are unlikely.
    assert cp.quality(spark, docs, str(tmp_path)).count() == n
