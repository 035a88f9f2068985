import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trawlframe.llm import mixing, packing

from .helpers import documents, duck, same, written


def optimum(items, capacity):
    """Fewest bins, by trying everything."""
    best, items = [len(items)], sorted(items, reverse=True)

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in {rooms.index(r) for r in rooms if r >= items[i]}:
            rooms[k] -= items[i]
            place(i + 1, rooms)
            rooms[k] += items[i]
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best[0]


def test_reduction_keeps_the_optimum_and_best_fit_is_a_packing():
    rng, fixed_pieces = random.Random(1), 0
    for _ in range(600):
        capacity = rng.choice([10, 20, 30])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = {x: items.count(x) for x in items}
        fixed, rest = packing.dominance_reduction(counts, capacity)
        fixed_pieces += sum(len(c) * n for c, n in fixed)
        left = [x for x, n in rest.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + optimum(left, capacity) == optimum(items, capacity)
        patterns = packing.plan(counts, capacity)
        assert sorted(x for c, n in patterns for x in c * n) == sorted(items) and all(sum(c) <= capacity for c, _ in patterns)
    assert fixed_pieces > 1000


def test_pieces_and_places(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "qzx", "été", "\n", "<|endoftext|>", "1234"]) for _ in range(rng.choice([0, 3, 200, 900, 3000]))) for _ in range(60)] + [None, "", " " * 5000, "x" * 30_000]
    folder = written(documents(spark, texts), tmp_path)
    found = packing.op2_best_fit_packing(spark, folder).toPandas().sort_values(["doc_id", "piece"])
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    for doc_id, rows in found.groupby("doc_id"):
        ids = np.array(tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids + [0], "<u4")
        assert rows["piece"].tolist() == list(range(len(rows)))
        assert (rows["start"] == rows["length"].cumsum() - rows["length"]).all() and rows["length"].sum() == len(ids)
        assert (rows["length"].iloc[1:] == 2048).all() and (len(rows) == 1 or len(ids) > 2048)
        for r in rows.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert set(found["doc_id"]) == set(range(len(texts)))
    ordered = found.sort_values(["sequence_id", "offset"])
    sums = ordered.groupby("sequence_id")["length"]
    assert (ordered["offset"] == sums.cumsum() - ordered["length"]).all() and sums.sum().max() <= 2048
    assert found["sequence_id"].nunique() <= -(-found["length"].sum() // 2048) + 2


def test_ranks_of_a_common_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 7)
    rows = [(i % 2 or None, 0, 0, 5 if i % 3 else 9, i) for i in range(100)]  # doc_ids repeat
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, row long")
    ranks = packing.ranked(pieces, {5: 66, 9: 34}).toPandas()
    for length, n in ((5, 66), (9, 34)):
        assert sorted(ranks[ranks.length == length]["rank"]) == list(range(n))


def test_packing_keeps_ids_and_empty_tables(spark):
    docs = documents(spark, ["some words", None])
    assert packing.packed(docs).filter(F.col("ids_crc32") == F.crc32("ids")).count() == 2
    assert packing.packed(docs.limit(0)).count() == 0


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        source = rng.choice(["big"] * 6 + ["mid", "mid", "small", None])
        rows.append((i, " ".join("w" for _ in range(rng.randint(0, 30))) if i % 50 else None, "en", source))
    return rows


def test_mixture_matches_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 10)
    folder = written(documents(spark, corpus(1)), tmp_path)
    found = mixing.op7_temperature_mixing(spark, folder).toPandas()
    same(found, duck(mixing.ORACLE, folder))
    assert found.groupby("doc_id").size().max() == 2


def test_repetition_limit_and_budget(spark):
    docs = documents(spark, corpus(2))
    words = {r[0]: len((r[1] or "").split()) for r in corpus(2)}
    uses = mixing.mix(docs, 0.8, 1.0).toPandas()
    assert not uses["doc_id"].duplicated().any()
    assert abs(uses["tokens"].sum() - 0.8 * sum(words.values())) < 4 * 30
    own = {s: sum(words[r[0]] for r in corpus(2) if r[3] == s) for s in ("big", "mid", "small", None)}
    share = {s: uses[uses["source"].isna() if s is None else uses["source"] == s]["tokens"].sum() / own[s] for s in own}
    assert share["small"] > 0.95 > share["big"]
    with pytest.raises(ValueError):
        mixing.mix(docs, 3.0, 2.0)


def test_target_entropy(spark):
    docs = documents(spark, corpus(3))
    uses = mixing.mix(docs, 1.0, 30.0, 1.3).toPandas()
    q = uses.groupby(uses["source"].fillna("-"))["tokens"].sum() / uses["tokens"].sum()
    assert abs(-(q * np.log(q)).sum() - 1.3) < 0.03


def test_mixed_keeps_columns_and_empty_tables(spark):
    docs = documents(spark, corpus(4)).withColumn("src", F.lit(1)).withColumn("tokens", F.lit("clash"))
    assert mixing.mixed(docs, 0.9, 1.0).columns == docs.columns
    assert mixing.mixed(docs.limit(0), 0.9, 1.0).count() == 0
    assert mixing.mixed(documents(spark, [None, ""]), 0.9, 1.0).count() == 0


def test_entropy_beyond_the_repetition_limit(spark):
    """One word against a million: an even mixture would use the word half a million times."""
    docs = documents(spark, [(0, "w", "en", "tiny")] + [(i, "w " * 1000, "en", "big") for i in range(1, 200)])
    uses = mixing.mix(docs, 0.9, 4.0, 0.69).toPandas()
    assert 1 <= (uses["source"] == "tiny").sum() <= 4 and uses["epoch"].max() <= 4


def test_one_doc_id_for_a_whole_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_ROWS", 5)
    rows = [(None if i % 2 else 7, "w " * (i % 9), "en", "hot") for i in range(400)] + [(i, "w w", "en", "b") for i in range(1000, 1050)]
    uses = mixing.mix(documents(spark, rows), 1.0, 1.0).toPandas()
    hot = uses[uses["source"] == "hot"].sort_values(["start", "tokens"])
    assert hot["tokens"].sum() == sum(i % 9 for i in range(400)) and (hot["start"].to_numpy() == (hot["tokens"].cumsum() - hot["tokens"]).to_numpy()).all()


@pytest.mark.parametrize("kind", ["string", "int"])
def test_other_ids_repeats_and_clashing_columns(spark, kind):
    rows = [(i % 3, "some words " * (i % 7)) for i in range(30)] + [(None, "w " * 100_000), (None, None)]
    docs = documents(spark, rows).withColumn("doc_id", F.col("doc_id").cast(kind))
    for clash in ("row", "length", "piece", "ids", "rank", "part", "epoch", "order", "sub", "uid"):
        docs = docs.withColumn(clash, F.lit("own"))
    packed = packing.packed(docs, ids=False)
    assert packed.schema["doc_id"].dataType.simpleString() == kind
    found = packed.toPandas().sort_values(["sequence_id", "offset"])
    sums = found.groupby("sequence_id")["length"]
    assert (found["offset"] == sums.cumsum() - found["length"]).all() and sums.sum().max() <= 2048
    assert found[found["doc_id"].isna()]["piece"].max() > 40 and len(found[found["piece"] == 0]) == 32
    uses = mixing.mix(docs, 1.0, 1.0).toPandas()
    assert uses["tokens"].sum() == 2 * sum(i % 7 for i in range(30)) + 100_000 and uses["tokens"].max() == 100_000
    assert mixing.mixed(docs, 1.0, 1.0).columns == docs.columns
