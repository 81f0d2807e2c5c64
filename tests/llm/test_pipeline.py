"""The five stages on a small table: planted cases go, clean documents stay."""

import random

import corpus_pipeline
from rillspark.session import written


def test_stages(spark, tmp_path):
    r = random.Random(11)
    word = lambda: "".join(r.choice("aeioudlnrst") for _ in range(r.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    item = prose(30)
    base = prose(120)
    near = base.replace(base.split()[60], "changed")
    rows = [prose(80) for _ in range(10)] + [base, near, base, f"{prose(40)} {item} {prose(20)}", "### *** $$$ " * 30, "short", None, f"{prose(40)} write to a.b@mail.example.com {prose(10)}"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {"quality": set(range(14)) | {17}, "near_dup": set(range(11)) | {13, 17}, "decontaminate": set(range(11)) | {17}, "pii": set(range(11)) | {17}}
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, str(tmp_path)))
        if name in kept:
            assert now.columns == docs.columns
            assert {x.doc_id for x in now.select("doc_id").collect()} == kept[name], name
        if name == "pii":
            assert "[EMAIL]" in now.where("doc_id = 17").first().text
    assert {x.doc_id for x in now.select("doc_id").collect()} == kept["pii"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()
