import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trawlframe.llm import common, language_id, simhash

from .helpers import documents, written
from .test_learned import LANGS, speech


def test_each_stage_takes_effect_and_keeps_the_columns(spark, tmp_path):
    import random

    rng = random.Random(1)
    rows = [(i, "\n".join(speech(rng, LANGS[x := rng.choice(["aa", "cc"])], 30) for _ in range(3)), x, rng.choice(["hot", "hot", "hot", "b", "c"])) for i in range(200)]
    rows += [(300, None, "aa", "b"), (301, "123 456", "aa", "b")]
    rows += [(302, rows[5][1], "aa", "b"), (303, rows[6][1] + "\nand a line of its own that nobody else has here", "aa", "b")]
    rows += [(304, " ".join(rows[7][1].split("\n")), rows[7][2], "b")]  # a copy in other lines
    rows += [(305, rows[8][1] + " again, and more of it", rows[8][2], None), (305, "w " * 2_000, "aa", "b")]  # a repeated doc_id, a null source, a long text
    docs = documents(spark, rows)
    for clash in ("uid", "score", "lang_pred", "pos", "line", "key", "band", "src", "tokens", "row", "length"):
        docs = docs.withColumn(clash, F.lit("own"))
    folder = written(docs, tmp_path)
    ids, frame = [], spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.materialize(stage(spark, frame, folder), name)
        assert frame.columns == docs.columns
        ids.append({r.doc_id for r in frame.select("doc_id").collect()})
    assert set(range(200)) | {302, 303, 304} <= ids[0] <= set(range(200)) | {302, 303, 304, 305}
    assert ids[1] == ids[0] - {302}
    assert ids[2] == ids[1] - {304}
    assert ids[3] < ids[2] and len(ids[3]) > 0.7 * len(ids[2])
    assert frame.filter("doc_id = 303").first() is None or frame.filter("doc_id = 303").first().text == "and a line of its own that nobody else has here"
    found = corpus_pipeline.run(spark, folder).toPandas()
    assert set(found["doc_id"]) == ids[3] and frame.filter("uid <> 'own'").count() == 0 and (found.groupby("sequence_id")["length"].sum() <= 2048).all()


def test_a_corpus_without_languages_stays(spark):
    rows = [(i, f"words of document {i}", None, None) for i in range(20)] + [(30, None, None, None), (31, "1 2 3", None, None)]
    docs = documents(spark, rows).withColumn("score", F.lit(7)).withColumn("lang_pred", F.lit("own"))
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == set(range(20)) and kept.columns == docs.columns


def test_stages_call_their_operators():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_dedup", "source_mixing", "packing"] and language_id and simhash


def test_empty_table(spark, tmp_path):
    folder = written(documents(spark, ["x"]).limit(0), tmp_path)
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_edited_copies_go(spark):
    import random

    rng = random.Random(7)
    words = [speech(rng, LANGS["aa"], 300).split() for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(words)]
    few, many = list(words[3]), list(words[4])
    for at in (50, 120, 200):  # 15 of 296 word runs: similarity 0.90
        few[at] = "edited"
    for at in range(10, 300, 20):  # 75 of 296: 0.60
        many[at] = "edited"
    rows += [(100, " ".join(few)), (101, " ".join(many)), (102, " ".join(words[5][:260]))]  # the last one: 256 of 296, 0.86
    kept = corpus_pipeline.drop_near_copies(spark, documents(spark, rows), "")
    assert {r.doc_id for r in kept.collect()} == {*range(30), 101}


@pytest.mark.parametrize("rows", [7, 1_024])
def test_near_copies_match_brute_force(spark, rows, monkeypatch):
    import random

    monkeypatch.setattr(simhash, "CLUSTER_ROWS", rows)
    rng = random.Random(8)
    texts = [speech(rng, LANGS["aa"], 80) for _ in range(6)]
    for _ in range(150):
        w = rng.choice(texts).split()
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = speech(rng, LANGS["cc"], 1)
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    kept = simhash.one_of_each(documents(spark, texts))
    assert {r.doc_id for r in kept.collect()} == set(label) and 6 < len(set(label)) < 150


@pytest.mark.parametrize("split", [5, 20_000])
def test_near_copies_are_brought_together_by_simhash(spark, split):
    """Clusters are the components of fingerprints that share a block and differ in NEAR_BUDGET bits or fewer; before, keys of minima made them."""
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 1 << 63, 60, np.uint64))]
    sets += [np.unique(np.append(sets[0][rng.random(60) < 0.9], rng.integers(0, 1 << 63, 5, np.uint64))) for _ in range(40)] + [np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for n in (1, 2, 30)]
    fps = [simhash.near_fingerprints(x).reshape(simhash.FINGERPRINTS, simhash.WORDS) for x in sets]
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            differ = fps[i] ^ fps[j]
            block = any((int(w) >> simhash.BLOCK_BITS * k) % (1 << simhash.BLOCK_BITS) == 0 for f in differ if np.bitwise_count(f).sum() <= simhash.NEAR_BUDGET for w in f for k in range(simhash.BLOCKS))
            if block:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    nodes = spark.createDataFrame([(i, f.ravel().view(np.int64).tolist()) for i, f in enumerate(fps)], "id long, words array<long>")
    found = {r.id: r.cluster for r in simhash.near_clusters(simhash.materialize(nodes, "nodes"), split).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == label and label[-3:] == [41, 42, 43] and len(set(label)) < 20


def test_workers_get_small_batches():
    """Before, all rows of an Arrow batch were held at once, with all that was made of them."""
    batches = [pa.RecordBatch.from_arrays([pa.array(range(n))], ["n"]) for n in (1_203, 0, 500)]
    parts = list(common.sliced(iter(batches), 500))
    assert [x.num_rows for x in parts] == [500, 500, 203, 500] and [v for x in parts for v in x.column(0).to_pylist()] == [*range(1_203), *range(500)]


def test_short_edited_copies_go(spark):
    """A run less of six, or of 33 to 49, where texts get fingerprints of one kind, of both, and of the other. Before, one in 25 pairs of five and six runs had no block of bits in common."""
    words = [[f"w{k}x{i}" for k in range(n)] for i, n in enumerate([10] * 300 + [37 + i % 17 for i in range(100)])]
    rows = [(i, " ".join(w)) for i, w in enumerate(words)] + [(1_000 + i, " ".join(w[1:])) for i, w in enumerate(words)]
    kept = simhash.one_of_each(documents(spark, rows))
    assert {r.doc_id for r in kept.collect()} == set(range(400))
    sizes = {n: len(simhash.near_words(np.arange(1, n + 1, dtype=np.uint64))) // (simhash.FINGERPRINTS * simhash.WORDS) for n in (0, 1, 32, 33, 40, 41)}
    assert sizes == {0: 0, 1: 1, 32: 1, 33: 2, 40: 2, 41: 1}


@pytest.mark.parametrize("labels", [50, 200_000])
def test_a_crowd_of_near_copies_has_few_links(spark, labels, monkeypatch):
    """Components are joined edge by edge, round by round. Before, every block of bits told a forest of its own and small groups all their pairs: 12 to 16 links a member of these crowds."""
    monkeypatch.setattr(simhash, "TREE_LABELS", labels)
    rng = np.random.default_rng(10)
    base, edges = np.unique(rng.integers(0, 1 << 63, 100, np.uint64)), {}
    for n in (150, 300, 600):
        sets = [np.unique(np.append(base[rng.random(100) < 0.96], rng.integers(0, 1 << 63, 3, np.uint64))) for _ in range(n)]
        nodes = simhash.materialize(spark.createDataFrame([(i, simhash.near_words(x).view(np.int64).tolist()) for i, x in enumerate(sets)], "label long, words array<long>"), "nodes")
        found = simhash.materialize(simhash.near_links(nodes, 0, simhash.FIRST), "links")
        edges[n] = simhash.thinned(found).count()
        assert {r.root for r in simhash.connected_components(simhash.thinned(found)).collect()} == {0}
        assert found.filter("a >= b").isEmpty() and found.count() <= 24 * n
    if labels > 600:
        assert all(n - 1 <= edges[n] <= 2 * n for n in edges)
