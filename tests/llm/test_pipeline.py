"""Stages of the corpus pipeline: columns, decisions, odd rows."""

import random

import pytest

import corpus_pipeline
from runlens.llm import jaccard, simhash
from tests.llm.test_operators import PASSAGE


def test_stages(spark, tmp_path):
    bench = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = "the river and the hill are part of a long tale that was told to children in winter by their old aunt"
    other = "a market in the town was full of people who came for bread and for news of the war on the coast"
    rows = [(1, clean), (2, clean), (2, clean), (3, other + " " + bench), (4, other + " password=abcdefgh12345"), (5, PASSAGE), (6, None), (None, other[::-1] + " the of")]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t) if t else None, "q", "c", "d", "i") for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, quality string, clean string, document string, `odd.id` string")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            kept.append(sorted((r.doc_id or 0) for r in docs.collect()))
    assert kept == [[0, 1, 2, 2, 3, 4], [0, 1, 3, 4], [0, 1, 4], [0, 1, 4]]
    row = docs.where("doc_id = 4").first()
    assert row.text == other + " [SECRET]" and row.n_chars == len(row.text)
    assert (row.quality, row.clean, row.document, row["odd.id"]) == ("q", "c", "d", "i")
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 4]


def changed(words, places):
    return " ".join("changed%d" % k if k in places else w for k, w in enumerate(words))


def test_near_duplicates_by_shingles_of_five_words(spark):
    rng = random.Random(7)
    base = [["w%d" % rng.randrange(10**6) for _ in range(200)] for _ in range(40)]
    rows = []
    for k, words in enumerate(base):  # 196 shingles: 4 changes leave 176 of 216 (0.81), 5 leave 171 of 221 (0.77)
        rows += [(10 * k, changed(words, ())), (10 * k + 1, changed(words, (10, 50, 90, 130))),
                 (10 * k + 2, changed(words, (20, 60, 100, 140, 180)))]
    found = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, found, "").collect())
    assert kept == sorted(i for i, _ in rows if i % 10 != 1)


def test_near_duplicates_of_rows_that_share_an_id(spark):
    one, two, three = ("%s " % w * 3 + " ".join("%s%d" % (w, k) for k in range(40)) for w in ("red", "green", "blue"))
    rows = [(7, one), (7, two), (7, one), (8, two), (9, three), (9, one), (3, None)]
    found = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, found, "").collect()}
    assert kept == {(7, one), (7, two), (9, three), (3, None)}


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(8)
    rows = [(None, "no id here at all"), (5, None), (6, ""), (7, "a b"), (8, "A  b"), (9, "no id here at all")]
    for k in range(12):
        words = ["w%d" % rng.randrange(10**6) for _ in range(120)]
        rows += [(100 + 20 * k + j, changed(words, set(rng.sample(range(120), rng.randrange(5))))) for j in range(12)]
    sets = [(i, jaccard.shingle_set(t)) for i, t in rows]
    near = {i: i for i, _ in rows if i is not None}
    for _ in rows:
        for i, a in sets:
            for j, b in sets:
                if i is not None and j is not None and jaccard.similarity(a, b) >= 0.8:
                    near[i] = near[j] = min(near[i], near[j])
        if all(near[near[i]] == near[i] for i in near):
            break
    found = jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == near
    assert [r.component_id for r in found if r.doc_id is None] == [9]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_copies(none).count() == 0


def test_near_copies_come_through_the_fingerprints(spark):
    rng = random.Random(9)
    rows = []
    for k in range(20):  # one changed word of 600 is a similarity of 0.98; of one key of 60 minima such a pair shares a third
        words = ["w%d" % rng.randrange(10**6) for _ in range(600)]
        rows += [(2 * k, changed(words, ())), (2 * k + 1, changed(words, {rng.randrange(600)}))]
    codes = {i: simhash.fingerprint_of(jaccard.shingle_set(t)) for i, t in rows}
    near = {i: i - 1 if i % 2 and ((codes[i] ^ codes[i - 1]) % (1 << 64)).bit_count() <= 4 else i for i in codes}
    assert sum(i != j for i, j in near.items()) > 15
    found = jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), bands=1, depth=60).collect()
    assert all(r.component_id == near[r.doc_id] for r in found if near[r.doc_id] != r.doc_id)


@pytest.mark.parametrize("block", [3, 1000])
def test_near_copies_of_one_centre_need_no_pairs(spark, block):
    rng = random.Random(6)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(1, 90):  # most copies are near the centre and not near each other; some only near another copy
        words = list(base if k < 70 else rows[rng.randrange(len(rows))][1].split(" "))
        for at in rng.sample(range(150), 2 if k < 70 else 3):
            words[at] = f"x{rng.random()}"
        rows.append((k, " ".join(words)))
    rows.append((0, " ".join(base)))
    sets = {i: jaccard.shingle_set(t) for i, t in rows}
    group = {i: {i} for i in sets}
    for i in sets:
        for j in sets:
            if i < j and group[i] is not group[j] and jaccard.similarity(sets[i], sets[j]) >= 0.8:
                group[i] |= group[j]
                for m in group[j]:
                    group[m] = group[i]
    found = jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), tries=1, block=block).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: min(g) for i, g in group.items()}
    assert len({min(g) for g in group.values()}) < 30
