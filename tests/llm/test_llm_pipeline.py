"""The pipeline on small tables, against plain versions of its stages."""

import random
from collections import Counter

import corpus_pipeline


def test_stages(spark, tmp_path):
    g = random.Random(4)
    say = lambda n: " ".join(f"w{g.randrange(3000)}" for _ in range(n))
    items = [(k, say(40)) for k in range(5)]
    rows = [say(60) for _ in range(20)]
    rows += [rows[0], rows[0] + " ", rows[1].replace(" ", "\n", 1)]  # copies
    near = rows[2].split()
    near[30] = "other"
    rows += [" ".join(near)]
    rows += [say(20) + " " + items[0][1] + " " + say(20), items[1][1]]  # leaks
    rows += [None, "", "123 456 !"]  # no language
    spark.createDataFrame([(k, t, "en", "s", 0, "x") for k, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, lang_pred string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = [set(range(26)), set(range(26)) - {20, 21, 22}, set(range(20)) | {24, 25}, set(range(20))]
    for (name, stage), keep in zip(corpus_pipeline.STAGES, want):
        columns = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got = {r.doc_id for r in docs.collect()}
        if name == "exact_dedup":  # of texts that are equal but for white space the longest stays
            assert len(got) == len(keep) and got >= set(range(2, 20)) | {23, 24, 25} and len(got & {0, 20, 21}) == 1 and 21 in got
        elif name == "near_dedup":
            assert got == (want[2] - {0}) | {21}
        elif name == "decontamination":
            assert got == (want[3] - {0}) | {21}
        else:
            assert got == keep
        assert docs.columns == columns
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    total = Counter()
    for r in pieces:
        total[r.doc_id] += r.length
    assert total.keys() == got and all(r.doc_tokens == total[r.doc_id] for r in pieces)


def test_rows_without_an_id_of_their_own(spark, tmp_path):
    g = random.Random(8)
    say = lambda n: " ".join(f"w{g.randrange(3000)}" for _ in range(n))
    item, alone = say(40), [say(60) for _ in range(4)]
    near = lambda t, k: " ".join([*t.split()[:k], "other", *t.split()[k + 1 :]])
    leak = lambda: say(20) + " " + item + " " + say(20)
    rows = [(None, alone[0]), (None, near(alone[0], 30)), (None, near(alone[0], 31)), (None, leak())]  # null ids: near copies, a leak
    rows += [(7, alone[1]), (7, near(alone[1], 30)), (7, alone[2]), (7, leak())]  # one id: near copies, another text, a leak
    rows += [(None, alone[3]), (9, near(alone[3], 30))]  # of a class with an id and without, that with the id stays
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    corpus_pipeline.near_copies(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/near")
    docs = spark.read.parquet(f"{tmp_path}/near")
    got = docs.collect()
    assert Counter(r.doc_id for r in got) == {None: 2, 7: 3, 9: 1}
    assert sum(r.text in (rows[4][1], rows[5][1]) for r in got) == 1 and rows[6][1] in {r.text for r in got}
    left = corpus_pipeline.benchmark_leaks(spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in left) == {None: 1, 7: 2, 9: 1}
    assert not any(item in r.text for r in left)
