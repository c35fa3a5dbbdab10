"""Alignment of two tokenizers, and token files, against plain loops over the texts."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runlens.llm import alignment, components, packing, token_files
from runlens.llm.common import fitted
from runlens.llm.packing import Encoder
from runlens.llm.queries import PIECES, QUERIES, TOKENIZER
from tests.llm.test_operators import SCHEMA, SF, TEXTS

MORE = [
    "<|endoftext|> x <s></s> <unk>", "▁ low line", " two  spaces  ", "tab\tand\nline\r\n", "😀😀 漢字漢字漢字 " * 20, "=" * 3000,
    "aaaa" * 700 + "b", "naïve café — “quotes” ﬁ ½", "\x00\x01\x7f", " " * 30_000 + "x", "word " * 60_000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    odd = ["".join(rng.choice("ab =\n\té漢😀▁<>|s0.") for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    rows = [(k, t, "en", "s", 0, "x", "y", 1, "z") for k, t in enumerate([*TEXTS, *MORE, *odd])]
    rows += [(5, TEXTS[5], "en", "s", 0, "x", "y", 1, "z"), (5, "other text", None, None, None, None, None, None, None),
             (None, "no id", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def plain_groups(text, a_model, b_model, a_names):
    if not text:
        return []
    a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
    of_a = [bytes(alignment_bytes[c] for c in a_names[i]) for i in a]
    of_b = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()
            for i in b for p in [b_model.id_to_piece(i)]]
    whole = (" " + text).encode()
    if b"".join(of_a) != whole or b"".join(of_b) != whole:
        return []
    groups, i, j, x, y, left, right = [], 0, 0, 0, 0, [], []
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            left.append(a[i])
            x += len(of_a[i])
            i += 1
        else:
            right.append(b[j])
            y += len(of_b[j])
            j += 1
        if x == y:
            groups.append((left, right))
            left, right = [], []
    return groups


def _shown_bytes():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


alignment_bytes = _shown_bytes()


def plain_alignment(rows):
    a_model = Tokenizer.from_file(TOKENIZER)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_names = {i: t for t, i in a_model.get_vocab().items()}
    found = [(r.doc_id, plain_groups(r.text, a_model, b_model, a_names)) for r in rows]
    held = [Counter((x, y) for left, right in g for x in left for y in right) for _, g in found]
    n = Counter(p for links in held for p in links)
    best = {}
    for (x, _), k in n.items():
        best[x] = max(best.get(x, 0), k)
    out = []
    for (doc, g), links in zip(found, held):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((
            doc, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(links.values()),
            sum(k for p, k in links.items() if n[p] == best[p[0]]), sum(k * n[p] for p, k in links.items()),
            hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return Counter(out)


@pytest.mark.parametrize("common", [0, 50, 200_000])
def test_alignment_equals_a_walk_over_the_bytes(docs, common):
    found = Counter(map(tuple, alignment.cross_tokenizer_alignment(docs, TOKENIZER, PIECES, common=common).collect()))
    assert found == plain_alignment(docs.collect())


def test_alignment_of_a_provided_table(spark):
    found = Counter(map(tuple, QUERIES["op11_cross_tokenizer_alignment"](spark, SF).collect()))
    assert found == plain_alignment(spark.read.parquet(f"{SF}/documents.parquet").collect())


def test_large_groups_are_counted_by_ids():
    rng = random.Random(1)
    a, b = [rng.randrange(5) for _ in range(900)], [rng.randrange(7) for _ in range(800)]
    pair, count, n = alignment.links(a, b, [300, 301, 900], [1, 2, 800])
    want = Counter()
    for i, j, k, m in ((0, 300, 0, 1), (300, 301, 1, 2), (301, 900, 2, 800)):
        want.update((x << alignment.BITS) | y for x in a[i:j] for y in b[k:m])
    assert dict(zip(pair.tolist(), count.tolist())) == dict(want) and n == want.total()


def test_common_pairs_stay_within_their_bound(spark):
    counted = spark.createDataFrame([(k, n) for k, n in enumerate([1] * 50 + [2] * 9 + [3] * 5 + [9] * 4)], "pair long, n long")
    for limit, least in ((1000, 1), (68, 1), (67, 2), (18, 2), (17, 4), (4, 4), (3, 16), (0, 16)):
        assert alignment.common_from(counted, limit) == least
        assert counted.where(f"n >= {least}").count() <= limit


def test_empty_tables(docs):
    none = docs.where("false")
    assert alignment.cross_tokenizer_alignment(none, TOKENIZER, PIECES).count() == 0
    assert token_files.read_tokens(token_files.write_tokens(none, TOKENIZER)).count() == 0


def plain_files(rows):
    """(id, start, n, crc): documents by id, those of one id in the order that `starts` found."""
    model = Tokenizer.from_file(TOKENIZER)
    ids = {t: [*model.encode(t or "", add_special_tokens=False).ids, 2] for t in {r.text for r in rows}}
    return [(r.doc_id, len(ids[r.text]), zlib.crc32(np.array(ids[r.text], "<u4").tobytes())) for r in rows]


@pytest.mark.parametrize("length", [1, 7, 1024])
def test_files_hold_all_ids_in_order(docs, length, tmp_path):
    index = token_files.write_tokens(docs, TOKENIZER, folder=f"file://{tmp_path}", length=length)
    found = token_files.read_tokens(index).orderBy("start").collect()
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1]]
    order = [(r.id is not None, r.id) for r in found]
    assert order == sorted(order, key=lambda x: (x[0], x[1] or 0))
    assert Counter((r.id, r.n_tokens, r.ids_crc32) for r in found) == Counter(plain_files(docs.collect()))


def test_sequences_are_views_of_equal_length(docs, tmp_path):
    index = token_files.write_tokens(docs, TOKENIZER, folder=f"file://{tmp_path}", length=16).collect()
    model = Tokenizer.from_file(TOKENIZER)
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    some = next(r for r in index if r.id == 4)
    text = next(t for k, t in texts if k == 4)
    file = token_files.Sequences(some.file)
    ids = np.concatenate([file[k][0] for k in range(some.place // 16, (some.place + some.n_tokens - 1) // 16 + 1)])
    at = some.place % 16
    assert ids[at:at + some.n_tokens].tolist() == [*model.encode(text, add_special_tokens=False).ids, 2]
    assert not file[0][0].flags.owndata and all(len(file[k][0]) == 16 for k in (0, len(file) - 1))
    total = sum(r.n_tokens for r in index if r.file == some.file)
    assert sum(file[k][1].true_count for k in range(len(file))) == total and len(file) == -(-total // 16)
    with pytest.raises(IndexError):
        file[len(file)]


def test_attempts_that_are_not_in_the_index_do_not_count(docs, tmp_path):
    index = token_files.write_tokens(docs, TOKENIZER, folder=f"file://{tmp_path}")
    before = token_files.read_tokens(index).count()
    some = index.first().file.removeprefix("file://")
    (tmp_path / "shard-000000-lost.arrow").write_bytes(open(some, "rb").read()[:100])
    assert token_files.read_tokens(index).count() == before == docs.count()


def test_one_id_with_most_rows_is_split(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    many = spark.range(4000).selectExpr("case when id % 3 = 0 then 7 else id end as doc_id", "'same text' as text")
    index = token_files.write_tokens(many, TOKENIZER, folder=f"file://{tmp_path}")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert index.where("id = 7").select("shard").distinct().count() > 1
    found = token_files.read_tokens(index).orderBy("start").collect()
    assert len(found) == 4000 and [r.id for r in found] == sorted(r.id for r in found)


def test_large_vocabularies_take_wide_ids():
    assert token_files.ids_type(1 << 16) == "uint16" and token_files.ids_type((1 << 16) + 1) == "uint32"


def test_both_engines_give_the_same_ids():
    rng = random.Random(9)
    texts = [t for t in [*TEXTS, *MORE] if t] + [
        "".join(chr(rng.choice([rng.randrange(1, 128), rng.randrange(128, 0xD000)])) for _ in range(60)) for _ in range(2000)]
    for specials in (True, False):
        encoder = Encoder(TOKENIZER, specials=specials)
        assert all(encoder.ids(t) == encoder.slow_ids(t) for t in texts)


def test_packing_needs_no_more_sequences_than_sequential_best_fit(spark):
    """Best-fit decreasing, one piece after the other, beside the rounds; many gaps of equal size."""
    from runlens.llm import packing
    rng = random.Random(12)
    for sizes in ([rng.randrange(1, 1025) for _ in range(700)], [rng.choice([3, 341, 342, 512, 513, 700]) for _ in range(700)],
                  [min(1024, int(rng.expovariate(1 / 90)) + 1) for _ in range(1500)]):
        gaps = []
        for size in sorted(sizes, reverse=True):
            k = min((k for k, g in enumerate(gaps) if g >= size), key=gaps.__getitem__, default=None)
            if k is None:
                gaps.append(1024 - size)
            else:
                gaps[k] -= size
        df = spark.createDataFrame(list(enumerate(sizes)), "pid long, length long")
        placed = packing.assign(df).collect()
        filled = Counter()
        for r in placed:
            filled[r.sequence] += r.size
        assert sorted(r.pid for r in placed) == list(range(len(sizes))) and max(filled.values()) <= 1024
        assert len(filled) <= 1.02 * len(gaps) + 1


def test_arrays_of_ids_and_their_bytes():
    first, second = Encoder(TOKENIZER, specials=False), alignment.PieceEncoder(PIECES)
    a_known, b_known = alignment.Vocabulary(first.token_bytes), alignment.Vocabulary(second.token_bytes)
    for text in (" Two  words", "日本語 \U0001F600 é", "<s></s> 1234", " " * 3000, "x", "\n\t a"):
        assert first.array(text).tolist() == first.ids(text)
        a, b = alignment.tokens(text, first, second, a_known, b_known)
        if len(a):
            assert a_known.joined(a) == b_known.joined(b) == b" " + text.encode()
        a_cuts, b_cuts = alignment.cuts(a, b, a_known, b_known)
        groups = [",".join(map(str, a[i:j])) + "|" + ",".join(map(str, b[k:m]))
                  for i, j, k, m in zip([0, *a_cuts], a_cuts, [0, *b_cuts], b_cuts)]
        assert alignment.digest(a, b, a_cuts, b_cuts) == (hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")


def test_few_pieces_are_few_tasks(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(1, 1024)) for k in range(300)]
    placed = packing.assign(spark.createDataFrame(rows, "pid long, length long").repartition(6))
    assert placed.count() == 300 and placed.rdd.getNumPartitions() < 2 * len(packing.bands(1024))


def test_few_links_are_few_tasks(spark):
    links = spark.range(1, 200).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v")).repartition(6)
    assert spark.range(0, 100, 1, 6).transform(lambda df: fitted(df, 3)).rdd.getNumPartitions() == 1
    assert components._small_star(components._large_star(links, 199), 199).rdd.getNumPartitions() == 1
    found = {r.node: r.component for r in components.connected_components(links, "u", "v").collect()}
    assert found == {k: 0 for k in range(200)}


def test_a_task_of_components_holds_one_step(spark, monkeypatch):
    """What one task computes of a round reads its links four times at most: steps do not hold each other's buffers."""
    reads, real = [], components.durable

    def seen(df):
        reads.append(df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD"))
        return real(df)

    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(139, 200), (300, 301), (301, 300), (7, 7)]
    links = spark.createDataFrame(edges, "u long, v long")
    monkeypatch.setattr(components, "durable", seen)
    found = {r.node: r.component for r in components.connected_components(links, "u", "v").collect()}
    assert found == {**{k: 0 for k in range(61)}, **{k: 100 for k in [*range(100, 140), 200]}, 300: 300, 301: 300}
    assert len(reads) > 3 and max(reads) <= 4, reads
