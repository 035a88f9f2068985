import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trawlframe.llm import exact_dedup, simhash
from trawlframe.llm.components import connected_components

from .helpers import documents, duck, same, written

BLANK = r"[\x20\x09-\x0D]+"


def texts(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "Δelta", "epsilon", "zeta.", "eta,", "THETA"]
    out = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 60, 900]))) for _ in range(n)]
    out += [t.replace(" ", rng.choice(["\n", "\t ", "  ", " "]), 3) for t in rng.sample(out, n // 3)]
    for t in rng.sample(out, n // 3):
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    return out + rng.sample(out, n // 3) + ["\xa0 x", " x", "x ", ""]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_matches_brute_force(spark, weak):
    rows = texts(1, 60) + [None, None]
    key = (lambda c: F.length(c) % 5) if weak else F.xxhash64  # the weak key makes different chunks meet
    found = exact_dedup.decide(documents(spark, rows), key).collect()
    groups = {}
    for i, t in enumerate(rows):
        groups.setdefault(re.sub(BLANK, " ", t or ""), []).append(i)
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found} == want


def test_exact_dedup_matches_sql(spark, tmp_path):
    folder = written(documents(spark, texts(2, 50)), tmp_path)
    same(exact_dedup.op3_exact_dedup(spark, folder).toPandas(), duck(exact_dedup.ORACLE, folder))


def test_chunks_give_the_text_back_and_follow_content(spark):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefghij klmno") for _ in range(9)) for _ in range(9000))
    rows = spark.createDataFrame([(text,), ("new beginning " + text,), ("語" * 20_000,)], "t string")
    a, b, c = (r.c for r in rows.select(exact_dedup.chunks(F.col("t")).alias("c")).collect())
    assert "".join(a) == text and "".join(c) == "語" * 20_000
    assert len(set(a) & set(b)) > len(a) * 0.8
    assert max(map(len, a + b + c)) <= exact_dedup.MAX_CHUNK


def test_exact_dedup_edges(spark):
    docs = documents(spark, [(1, "x"), (1, "x"), (None, "x"), (None, "only"), (2, "y" * 200_000), (3, "y" * 200_000)]).withColumn("uid", F.lit("own")).withColumn("ids", F.lit(1))
    kept = exact_dedup.deduplicated(docs)
    assert sorted((r.doc_id or 0, len(r.text)) for r in kept.collect()) == [(0, 4), (1, 1), (2, 200_000)]
    assert kept.columns == docs.columns
    assert exact_dedup.decide(docs.limit(0)).count() == 0


def brute_fingerprint(text):
    words = [w for w in re.split(BLANK, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_simhash_matches_brute_force(spark, tmp_path):
    rows = texts(4, 90) + [None, "one", "ONE", "one two", "É é É"]
    found = simhash.op9_simhash(spark, written(documents(spark, rows), tmp_path)).toPandas().sort_values("doc_id")
    fps = [brute_fingerprint(t) for t in rows]
    assert found["fingerprint"].tolist() == [f"{f:016x}" for f in fps]
    assert found["component_id"].tolist() == brute_classes(fps)


@pytest.mark.parametrize("split", [3, 20_000])
def test_links_of_crowded_fingerprints(spark, split):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:60]:
        for _ in range(4):
            f ^= 1 << rng.randrange(64)
            fps.add(f ^ (1 << rng.randrange(64) if rng.random() < 0.5 else 0))
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.links(nodes, split)).collect()}
    want = brute_classes(fps)
    groups, got = {}, {}
    for f, w in zip(signed, want):
        groups.setdefault(w, set()).add(f)
        got.setdefault(roots.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_trie_agrees_with_pairs():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(1 << int(rng.integers(64))) for _ in range(30)] + [base]))
    want = brute_classes(fps.tolist())
    forest = simhash.Forest(len(fps))
    for a, b in simhash.trie_links(fps):
        assert (int(fps[a]) ^ int(fps[b])).bit_count() <= 2 and forest.link(a, b)
    assert [forest.find(i) for i in range(len(fps))] == want


def test_one_of_each(spark):
    rows = [(5, "a b c d e"), (4, "a  b c d e"), (4, "a b c d e"), (9, None), (8, "  "), (None, "quite another text with other words")]
    docs = documents(spark, rows).withColumn("fp", F.lit(1)).withColumn("uid", F.lit(2))
    kept = simhash.one_of_each(docs)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["4", "8", "None"] and kept.columns == docs.columns
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    assert all(roots[i] == 0 for i in range(61)) and {roots[i] for i in (100, 101, 102)} == {100}
    assert connected_components(edges.limit(0)).count() == 0


def test_simhash_with_other_ids_repeats_and_long_texts(spark, tmp_path):
    rows = [("b", "same words in a row"), ("a", "Same  words in a row"), ("a", "same words in a row"), (None, "same words in a row"), ("c", "w x y " * 60_000), ("d", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumn("fp", F.lit(1)).withColumn("key", F.lit(1))
    found = simhash.op9_simhash(spark, written(docs, tmp_path)).collect()
    assert sorted((r.doc_id or "", r.component_id) for r in found) == [("", "a"), ("a", "a"), ("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")]
    assert simhash.one_of_each(docs).count() == 3


def test_repeated_doc_ids_match_sql(spark, tmp_path):
    rows = [(1, "x y"), (1, "x  y"), (2, "x\ty"), (2, "z"), (2, "z"), (3, None), (4, "")]
    documents(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    same(exact_dedup.op3_exact_dedup(spark, str(tmp_path)).toPandas(), duck(exact_dedup.ORACLE, tmp_path))
