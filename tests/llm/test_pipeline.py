import random

import corpus_pipeline
from logweave.llm import decontaminate, tensor_minhash

WORDS = [a + b for a in "ba ce di fo gu ha je".split() for b in "lan ter mip sor vek".split()]


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    rng = random.Random(1)
    text = lambda n: "\n".join(" ".join(rng.choice(WORDS) for _ in range(10)) + "." for _ in range(n))
    rows = [(i, text(8), "en", f"s{i % 12}") for i in range(200)]
    for i in range(0, 200, 5):
        rows[i] = (i, rows[i][1] + "\nYou rotter and blighter.", "en", rows[i][3])
    rows += [(300 + i, rows[1][1], "en", "s1") for i in range(5)]
    item = " ".join(rng.choice(WORDS) for _ in range(25))
    rows += [(400, text(8) + " " + item, "en", "s2"), (401, None, "de", "s3"), (402, "", None, None)]
    d = str(tmp_path)
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now, seen = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, d)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == docs.columns
        now.write.parquet(f"{d}/out{k}")
        now = spark.read.parquet(f"{d}/out{k}")
        seen[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    tox, lines, near, clean, mixed = seen.values()
    assert all(i not in tox for i in range(0, 200, 5)) and 1 in tox and 401 in tox and 402 in tox
    assert lines.keys() == tox.keys()
    assert 1 in near and not any(300 + i in near for i in range(5)) and near.keys() >= {401, 402, 400}
    assert item not in clean[400] and clean.keys() == near.keys()
    assert mixed.keys() <= clean.keys() and len(mixed) > 20
    assert corpus_pipeline.run(spark, d).count() == len(mixed)
    assert decontaminate.remove(docs.limit(0), spark.read.parquet(f"{d}/benchmark.parquet")).count() == 0
    assert tensor_minhash.keep_one(docs.limit(0)).count() == 0
