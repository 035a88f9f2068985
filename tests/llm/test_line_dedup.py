import random

import pytest
from pyspark.sql import functions as F

from trawlframe.llm import common, line_dedup

from .helpers import documents, duck, same, written

ALPHABET = "abcdefgh ijklmnop"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def variants(seed: int, n: int) -> list[str]:
    """Lines around a few roots: changed, added and missing characters, runs, and lines just beyond the threshold."""
    rng = random.Random(seed)
    roots = ["".join(rng.choice(ALPHABET) for _ in range(rng.choice([40, 41, 55, 90]))) for _ in range(6)] + ["a" * 45, "ab" * 24]
    out = list(roots)
    while len(out) < n:
        line = list(rng.choice(out))
        at = rng.randrange(len(line))
        kind = rng.randrange(4)
        if kind == 0:
            line[at] = rng.choice(ALPHABET)
        elif kind == 1:
            line.insert(at, rng.choice(ALPHABET))
        elif kind == 2:
            del line[at]
        else:
            line[at], line[-1] = "z", "y"
        out.append("".join(line))
    return out


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_matches_brute_force(spark, tmp_path, threshold):
    lines = variants(3, 220)
    rng = random.Random(4)
    docs = ["\n".join(rng.choice(lines) if rng.random() < 0.8 else rng.choice(["short", "", " \t"]) for _ in range(rng.randint(1, 5))) for _ in range(120)]
    folder = written(documents(spark, docs), tmp_path)
    found = line_dedup.decide(spark.read.parquet(f"{folder}/documents.parquet"), threshold).toPandas()
    assert found["n_links"].sum() > 0
    same(found, duck(line_dedup.oracle(threshold), folder))


def test_crowded_segments_match_brute_force(spark, monkeypatch):
    """Groups of two are split again, down to the last level."""
    monkeypatch.setattr(line_dedup, "LEVELS", 4)
    monkeypatch.setattr(line_dedup, "FEW", 1)
    lines = sorted(set(variants(5, 150)))
    frame = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    found = {(r.a, r.b) for r in line_dedup.pairs(frame, 2, hot=2).collect()}
    near = {(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if distance(lines[i], lines[j]) <= 2}
    assert near and near <= found


@pytest.mark.parametrize("wanted_share", [50, 1])
def test_the_filter_keeps_every_wanted_row(spark, wanted_share, monkeypatch):
    monkeypatch.setattr(common, "MAX_BITS", 1 << 17)
    rows = spark.range(20_000).selectExpr("xxhash64(id) as id", "id as n")
    wanted = line_dedup.materialize(rows.filter(f"n % {wanted_share} = 0").select("id"), "wanted")
    found = common.likely(rows, wanted).collect()
    assert {r.n for r in found} >= set(range(0, 20_000, wanted_share)) and (wanted_share == 1 or len(found) < 2500)
    assert common.likely(rows, wanted.limit(0)).count() == 0


def test_two_lines_of_a_million_characters(spark):
    line = "".join(random.Random(6).choices("abcdefgh ", k=1_000_000))
    texts = [line, line[:400_000] + "X" + line[400_001:700_000] + line[700_001:], line[:300_000] + "YYY" + line[300_000:], line[::-1]]
    found = line_dedup.decide(documents(spark, texts)).toPandas().set_index("doc_id").sort_index()
    assert found["n_links"].tolist() == [1, 1, 0, 0] and found["dropped"].tolist() == ["", "0:0:0", "", ""]


def test_repeated_doc_ids_match_sql(spark, tmp_path):
    line = "a line of more than forty characters that several rows of one id hold"
    rows = [(1, line), (1, line), (1, line + "!"), (2, line + "\n" + line), (2, "x"), (2, "x"), (3, None)]
    docs = documents(spark, rows).coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    same(line_dedup.op8_line_dedup(spark, str(tmp_path)).toPandas(), duck(line_dedup.ORACLE, tmp_path))


def test_many_variants_of_one_character(spark, tmp_path):
    base = "a line that occurs with a different sign in every document: {} end"
    docs = [base.format(chr(0x4E00 + i)) for i in range(300)]
    found = line_dedup.op8_line_dedup(spark, written(documents(spark, docs), tmp_path)).toPandas()
    assert found["n_links"].tolist() == [299] * 300
    assert found["n_dropped"].sum() == 299


def test_nulls_repeats_and_empty_tables(spark, tmp_path):
    line = "the very same line of more than forty characters, twice"
    rows = [(1, None), (2, ""), (3, line), (3, line), (None, line), (4, line + "\nother words stay here"), (5, "x" * 60_000)]
    docs = documents(spark, rows).withColumn("pos", F.lit(1)).withColumn("line", F.lit("clash"))
    kept = line_dedup.deduplicated(docs).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept) == [1, 2, 3, 4, 5]
    assert [r.text for r in kept if r.doc_id == 4] == ["other words stay here"]
    assert all(r.n_chars == len(r.text) for r in kept if r.text is not None)
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0


def test_short_lines_take_part_when_equal(spark, tmp_path):
    rows = [(i, f"Read more\n\nwords of document {i} alone\n{i}\n ") for i in range(60)] + [(60, "Read more!"), (61, "Read more\n"), (62, "59")]
    docs = documents(spark, rows)
    kept = {r.doc_id: r.text for r in line_dedup.deduplicated(docs).collect()}
    assert kept[0] == rows[0][1] and kept[60] == "Read more!" and set(kept) == set(range(61))
    assert all(kept[i] == f"\nwords of document {i} alone\n{i}\n " for i in range(1, 60))
    found = {r.doc_id: (r.n_dropped, r.dropped) for r in line_dedup.op8_line_dedup(spark, written(docs, tmp_path)).collect()}
    assert found[0] == found[60] == (0, "") and found[5] == (1, "0:0:0") and found[61] == (1, "0:0:0") and found[62] == (1, "0:59:3")


@pytest.mark.parametrize("budget", [1, 2, 3])
def test_edit_distance(spark, budget):
    rng = random.Random(budget)
    pairs = [("", ""), ("", "a" * budget), ("a" * (budget + 1), ""), ("😀" * 9, "😀" * 8 + "é")]
    for _ in range(300):
        a = "".join(rng.choice("abé😀") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "é"])
        pairs.append((a, "".join(b)))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.within(F.col("a"), F.col("b"), budget).alias("near")).collect()
    assert all(r.near == (distance(r.a, r.b) <= budget) for r in got)


def test_differences_in_letters_are_not_listed(spark, monkeypatch):
    """Before, 40 copies with another word in one place were all listed in pairs."""
    rng = random.Random(9)
    base = "".join(rng.choice(ALPHABET) for _ in range(400))
    lines = [base[:200] + "".join(rng.choice("abcdefgh") for _ in range(9)) + base[200:] for _ in range(40)]
    lines += [x[:300] + "Z" + x[301:] for x in lines[:5]]
    rows, listed, old = list(enumerate(lines)), [], line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name: listed.append(old(df, name)) or listed[-1] if name == "line-pairs" else old(df, name))
    found = {(r.a, r.b) for r in line_dedup.pairs(spark.createDataFrame(rows, "id long, line string"), 2).collect()}
    near = {(i, j) for i in range(45) for j in range(i + 1, 45) if distance(lines[i], lines[j]) <= 2}
    assert near == {(i, i + 40) for i in range(5)} and near <= found
    assert len(found) < 100 and sum(x.count() for x in listed) < 400
