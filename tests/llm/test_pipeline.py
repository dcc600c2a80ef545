import random
from collections import Counter

import corpus_pipeline
from salvora.llm import decontamination, simhash, toxicity
from tests.llm.test_models import DOCS, edit_distance_within, slow_score, toxic_docs
from tests.llm.test_native import slow_targets
from tests.llm.test_simhash import slow_sets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_and_their_decisions(spark, tmp_path):
    rng = random.Random(1)
    docs, labels = toxic_docs(600)
    docs = [(i, t, "en", f"src{i % 4}", len(t)) for i, t, *_ in docs]
    item = "a passage of a benchmark that must not be in any training text whatever"
    docs += [(10_000 + k, docs[1][1], "en", "copy", 1) for k in range(30)]
    docs += [(20_000, "before " + item + " after", "en", "src1", 1), (20_001, 'my token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" is in here with other words', "en", "src2", 1), (None, "a row without an id", None, None, None)]
    near = next(t for (_, t, *_), (_, _, bad) in zip(docs, labels) if not bad).split() + [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    docs += [(25_000, " ".join(near), "en", "src1", 1), (30_000, " ".join(near[:-1] + ["other"]), "en", "src2", 1), (30_001, " ".join(reversed(near)), "en", "src3", 1), (20_002, item.replace("passage", "pasage").upper(), "en", "src3", 1)]
    rng.shuffle(docs)
    folder = str(tmp_path)
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "secrets", "mixing"]
    now = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = stage(spark, now, folder).checkpoint() if name != "toxicity" else stage(spark, now, folder).cache()
        kept[name] = now
        if name != "mixing":
            assert now.columns == COLUMNS and now.schema == before.schema
    ids = lambda name: sorted(r.doc_id for r in kept[name].filter("doc_id is not null").collect())
    text_of = {i: t for i, t, *_ in docs if i is not None}
    truth = {i: t for i, _, t in labels}
    stays = [i for i in ids("toxicity") if i in truth]
    assert sum(truth[i] for i in stays) <= 5 and len(stays) >= 0.97 * sum(t == 0 for t in truth.values())
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert ids("toxicity") == sorted(i for i, t in text_of.items() if slow_score(t, model) < 0.5)
    # one of each class of texts whose sets of five words are 0.8 alike, directly or through others
    some = ids("toxicity")
    sets, root = {i: slow_sets(text_of[i]) for i in some}, {i: i for i in some}
    for x in some:
        for y in some:
            if y < x and (sets[x] == sets[y] or 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])) and root[x] != root[y]:
                old, new = max(root[x], root[y]), min(root[x], root[y])
                root = {i: new if r == old else r for i, r in root.items()}
    assert ids("simhash") == sorted(set(root.values())) and not [i for i in ids("simhash") if 10_000 <= i < 20_000]
    assert 30_000 in ids("toxicity") and 30_000 not in ids("simhash") and 30_001 in ids("simhash")  # a near copy and one that is none
    leaks = {i for i in ids("simhash") if edit_distance_within(item, " ".join(text_of[i].lower().split())) <= decontamination.budget(item)}
    assert leaks == {20_000, 20_002} and set(ids("decontamination")) == set(ids("simhash")) - leaks
    token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    want = {i: text_of[i].replace(token, "[SECRET]") for i in ids("decontamination")}
    assert {r.doc_id: r.text for r in kept["secrets"].filter("doc_id is not null").collect()} == want and token not in want[20_001]
    assert kept["secrets"].filter("doc_id is null").count() == 1
    sizes, taken = Counter(), Counter()
    for r in kept["secrets"].collect():
        sizes[r.source] += len((r.text or "").split())
    mixed = {}
    for r in kept["mixing"].collect():
        assert r.taken == r.copies * r["size"] + r.part_words and 0 < r.taken <= 3 * r["size"] and r["size"] == len((want.get(r.doc_id) or "a row without an id").split())
        taken[r.source] += r.taken
        mixed[r.doc_id] = r.taken
    goal = slow_targets(dict(sizes))
    assert all(abs(taken[s] - goal[s]) <= 0.5 for s in sizes)
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == set(mixed)


def test_repeated_ids_leave_one_row(spark):
    rows = [(1, "one text of several words", "a", "s", 1), (1, "one text of several words", "b", "s", 1), (2, "one text of several words", "c", "s", 1), (3, "something else altogether here", "d", "s", 1), (None, None, None, None, None)]
    got = simhash.keep_one(spark.createDataFrame(rows, DOCS))
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "3", "None"]
    assert simhash.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_empty_documents(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, "an item")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
