import math
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
from pyspark.sql import functions as F

from trawlframe.llm import language_id, quality_classifier, quality_rules, toxicity

from .helpers import documents, written

LANGS = {"aa": "abcde", "bb": "efghi", "cc": "klmno", "dd": "pqrst", "ee": "uvwxy", "ff": "aeiou", "gg": "zyxwv"}


def speech(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_codewords_are_apart():
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 12, 60):
        code = language_id.codewords(n)
        assert code.shape[0] == n and set(np.unique(code)) <= {-1.0, 1.0}
        if n > 1:
            apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * code.shape[1]
            assert apart.min() >= 1 and (n < 6 or apart.min() >= code.shape[1] / 5)
            bits = {tuple(bit * bit[0]) for bit in code.T}
            assert len(bits) == code.shape[1] and (1.0,) * n not in bits  # none alike, complementary or constant


def test_decoding_matches_the_definition():
    """Mean log-ratios, losses weighted by accuracy, nearest codeword: once more, one number at a time."""
    rng = random.Random(2)
    counts = np.zeros((4, 1 << language_id.BUCKET_BITS))
    for i in range(4):
        for g in language_id.ngrams(speech(rng, LANGS[["aa", "bb", "ff", "ee"][i]], 300)).tolist():
            counts[i, g] += 1
    model = language_id.Model(["aa", "bb", "ff", "ee"], counts)
    accuracy = np.array([[0.5 + 0.5 * rng.random() for _ in range(model.code.shape[1])] for _ in range(4)])
    model.weigh(accuracy)
    share = [(c + 0.5) / (c + 0.5).sum() for c in counts]
    for letters in LANGS.values():
        text = speech(rng, letters, 12)
        grams = language_id.ngrams(text).tolist()
        margins = []
        for bit in model.code.T.tolist():
            yes, no = ([share[i] for i in range(4) if bit[i] == side] for side in (1, -1))
            evidence = sum(math.log(sum(s[g] for s in yes) / len(yes)) - math.log(sum(s[g] for s in no) / len(no)) for g in grams)
            margins.append(evidence / len(grams) * min(len(grams), language_id.EVIDENCE))
        loss = [sum(a / sum(accuracy[i]) * math.log1p(math.exp(-c * m)) for a, c, m in zip(accuracy[i], model.code[i], margins)) for i in range(4)]
        best = loss.index(min(loss))
        near = [math.exp(-(x - loss[best]) * len(margins)) for x in loss]
        lang, score, ambiguous = model.decode(model.margins(text))
        assert lang == model.languages[best] and abs(score - near[best] / sum(near)) < 1e-3
        assert ambiguous == (sorted(loss)[1] - loss[best] < language_id.AMBIGUOUS)


def test_language_id(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, speech(rng, LANGS[x := rng.choice(list(LANGS))], 30), x, "s") for i in range(400)]
    rows += [(400, None, "aa", None), (401, "", "aa", None), (402, "12 3!", "aa", None), (403, "Ж", None, None), (None, speech(rng, LANGS["bb"], 30), None, None), (404, speech(rng, LANGS["cc"], 30_000), "cc", "s")]
    found = language_id.op1_language_id(spark, written(documents(spark, rows), tmp_path)).toPandas()
    truth = {r[0]: r[2] for r in rows}
    by = found.dropna(subset="doc_id").set_index("doc_id")
    assert all(by.loc[i, "held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(405))
    assert by.loc[[400, 401, 402], "lang_pred"].tolist() == ["und"] * 3 and by.loc[[400, 401, 402], "score"].tolist() == [0.0] * 3
    held = [i for i in range(400) if by.loc[i, "held_out"]]
    assert np.mean([by.loc[i, "lang_pred"] == truth[i] for i in held]) > 0.97
    assert by.loc[404, "lang_pred"] == "cc" and by.loc[403, "lang_pred"] in LANGS and by["score"].between(0, 1).all()
    assert found[found["doc_id"].isna()]["lang_pred"].tolist() == ["bb"]


def test_language_id_without_anything_to_learn(spark):
    docs = documents(spark, ["words", None]).withColumn("Score", F.lit(1))
    assert language_id.fit(docs) is None
    found = language_id.identify(docs, None)
    assert found.columns == [*docs.columns[:-1], "lang_pred", "score", "ambiguous"] and found.filter("lang_pred = 'und' and score = 0").count() == 2
    kept = language_id.identify(docs, None, ("l", "s", "a"))
    assert kept.columns == [*docs.columns, "l", "s", "a"] and {r.Score for r in kept.collect()} == {1}
    assert language_id.identify(docs.limit(0), None).count() == 0


def labelled(spark, tmp_path, rows, labels):
    folder = written(documents(spark, rows), tmp_path)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return folder


def test_quality_classifier(spark, tmp_path):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        text = speech(rng, "abcdefg", 60)
        rows.append((i, text if good else text.replace(" ", "!! ")))
        labels.append((i, int(good), 0))
    rows += [(400, None), (401, ""), (402, "abc " * 40_000)]
    labels += [(0, None, 0), (402, 1, 0), (999, 1, 0), (402, 0, 0), (None, 1, 1)]
    found = quality_classifier.op10_quality_classifier(spark, labelled(spark, tmp_path, rows, labels)).toPandas().set_index("doc_id")
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert found.loc[held, "held_out"].all() and not found.loc[[i for i in range(400) if i not in held], "held_out"].any()
    assert np.mean([found.loc[i, "predicted"] == labels[i][1] for i in held]) > 0.97
    assert found["score"].between(0, 1).all() and len(found) == 403 and (found["predicted"] == (found["score"] >= 0.5)).all()


def test_toxicity(spark, tmp_path):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        bad = rng.random() < 0.3
        words = speech(rng, "abcdefghij", 50).split()
        if bad:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), "Zonk" + rng.choice(["er", "ish", "y", "o"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    rows += [(600, None), (601, ""), (602, "é zonker!"), (603, "calm words " * 20_000)]
    found = toxicity.op5_toxicity(spark, labelled(spark, tmp_path, rows, labels)).toPandas().set_index("doc_id")
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert found.loc[held, "held_out"].all()
    assert np.mean([found.loc[i, "predicted"] == labels[i][2] for i in held]) > 0.97
    assert found.loc[602, "spans"] == "2:8" and found.loc[[600, 601, 603], "predicted"].tolist() == [0, 0, 0]
    for i in held:
        for a, b in (s.split(":") for s in found.loc[i, "spans"].split(",") if s):
            assert rows[i][1][int(a) : int(b)].startswith("Zonk")


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(4)
    lengths, trans = np.array([3, 0, 5, 1]), rng.normal(size=(2, 2))
    scores = rng.normal(size=9)
    chains = toxicity.Chains(lengths)
    p, ahead, behind = chains.marginals(scores, trans)
    want, pairs, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        total, ones, steps = 0.0, np.zeros(n), np.zeros((2, 2))
        for m in range(1 << n) if n else ():
            y = [m >> i & 1 for i in range(n)]
            w = np.exp(sum(scores[at + i] * y[i] for i in range(n)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            total += w
            ones += w * np.array(y)
            for a, b in zip(y, y[1:]):
                steps[a, b] += w
        if n:
            want += (ones / total).tolist()
            pairs += steps / total
        at += n
    assert np.allclose(p, want) and np.allclose(chains.pairs(scores, trans, ahead, behind), pairs)


def test_word_features_are_all_there_and_in_order():
    word = "donaudampfschifffahrtsgesellschaft".encode()
    assert len(toxicity.word_features(word)) == 1 + 4 + 2 + len({word[i : i + 4] for i in range(len(word) - 3)})
    code = "from trawlframe.llm import toxicity; print(toxicity.word_features(b'donaudampfschifffahrtsgesellschaft'))"
    told = {subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONHASHSEED": str(k), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(__file__)))}, capture_output=True, text=True, check=True).stdout for k in range(3)}
    assert len(told) == 1


def test_document_score_matches_enumeration():
    """Score and marginals of a text with features summed and every tagging enumerated."""
    rng = np.random.default_rng(9)
    field = toxicity.Field()
    field.unary, field.left, field.right = (rng.normal(size=1 << toxicity.DIM_BITS) for _ in range(3))
    field.bias, field.trans, field.last = -0.7, rng.normal(size=(2, 2)), np.array([0.2, 0.5, 0.3])
    text = "Some words of a Zonkerish kind"
    words = [w.encode() for w in text.lower().split()]
    own = []
    for i, w in enumerate(words):
        x = field.bias + sum(field.unary[b] for b in toxicity.word_features(w))
        x += field.left[toxicity.beside_feature(words[i - 1], b"<")] if i else 0
        x += field.right[toxicity.beside_feature(words[i + 1], b">")] if i + 1 < len(words) else 0
        own.append(x)
    total, ones = 0.0, np.zeros(len(words))
    for m in range(1 << len(words)):
        y = [m >> i & 1 for i in range(len(words))]
        weight = math.exp(sum(x * v for x, v in zip(own, y)) + sum(field.trans[a, b] for a, b in zip(y, y[1:])))
        total, ones = total + weight, ones + weight * np.array(y)
    p = ones / total
    want = 1 / (1 + math.exp(-(0.2 + 0.5 * math.log(p.max() / (1 - p.max())) + 0.3 * math.log(p.sum() + 1e-3))))
    scores, marginals = toxicity.Tagger(field).tag([text, None])
    assert np.allclose(marginals[0], p) and abs(scores[0] - want) < 1e-6


def test_ftrl_matches_the_published_updates():
    """Per-coordinate FTRL-proximal, one coordinate at a time."""
    rng = np.random.default_rng(12)
    rows = []
    for _ in range(40):
        at = np.unique(rng.integers(0, 50, 6))
        rows.append((at, rng.normal(size=len(at)), int(rng.random() < 0.4)))
    got = quality_classifier.train(rows, seed=3)
    z, n = {}, {}

    def weight(i):
        own = z.get(i, 0.0)
        if abs(own) <= quality_classifier.L1:
            return 0.0
        return -(own - math.copysign(quality_classifier.L1, own)) / ((quality_classifier.BETA + math.sqrt(n.get(i, 0.0))) / quality_classifier.ALPHA + quality_classifier.L2)

    ones = sum(r[2] for r in rows)
    order = np.random.default_rng(3)
    for _ in range(quality_classifier.EPOCHS):
        for k in order.permutation(len(rows)).tolist():
            at, x, y = rows[k]
            w = {i: weight(i) for i in at.tolist()}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(at.tolist(), x))))
            for i, v in zip(at.tolist(), x):
                g = (p - y) * v * len(rows) / 2 / (ones if y else len(rows) - ones)
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality_classifier.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    assert np.allclose(got[:50], [weight(i) for i in range(50)]) and np.abs(got).max() > 0


def test_samples_are_bounded_in_rows_and_bytes(spark, tmp_path):
    rows = [(i % 10, f"text {i % 10} number {i:04d} " + "w " * 50) for i in range(400)]
    folder = labelled(spark, tmp_path, rows, [(i, i % 2, i % 2) for i in range(10)])
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    found = quality_classifier.labelled(docs, labels, "quality", F.lit(False), 100, "x")
    assert sorted(r.text[:16] for r in found.collect()) == [f"text {i} number 00" for i in range(10)]
    sample = found.select(F.xxhash64("doc_id").alias("order"), "text")
    size = F.octet_length("text")
    assert quality_classifier.bounded(sample, size, 350).agg(F.sum(size)).first()[0] <= 350
    assert quality_classifier.bounded(sample, size, 350).count() == 2 and quality_classifier.bounded(sample, size, 1 << 20).count() == 10


def test_learned_operators_with_other_ids_repeats_and_empty_tables(spark, tmp_path):
    rows = [(i, f"good calm words {i}" if i % 2 else f"Zonk bad!! words!! {i}") for i in range(60)] * 2 + [(None, "good calm words")]
    labels = [(str(i), i % 2, 1 - i % 2) for i in range(60)]
    docs = documents(spark, rows).withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("score", F.lit("own")).withColumn("y", F.lit(1)).withColumn("order", F.lit(2))
    folder = written(docs, tmp_path)
    spark.createDataFrame(labels, "doc_id string, quality int, toxic int").withColumn("text", F.lit("clash")).coalesce(1).write.parquet(f"{folder}/labels.parquet")
    for op, n in ((toxicity.op5_toxicity, 2), (quality_classifier.op10_quality_classifier, 2), (language_id.op1_language_id, 2), (quality_rules.op6_quality_rules, 2)):
        found = op(spark, folder)
        assert found.schema["doc_id"].dataType.simpleString() == "string"
        by = found.toPandas().groupby("doc_id", dropna=False).size()
        assert by.sum() == 121 and by.loc["3"] == n
    empty = written(docs.limit(0), tmp_path / "none")
    spark.createDataFrame([], "doc_id string, quality int, toxic int").coalesce(1).write.parquet(f"{empty}/labels.parquet")
    for op in (toxicity.op5_toxicity, quality_classifier.op10_quality_classifier, language_id.op1_language_id, quality_rules.op6_quality_rules):
        assert op(spark, empty).count() == 0


def test_without_labels(spark, tmp_path):
    folder = labelled(spark, tmp_path, ["a b", None], [(0, 1, 0)])
    for op in (toxicity.op5_toxicity, quality_classifier.op10_quality_classifier):
        assert [r.score for r in op(spark, folder).collect()] == [0.5, 0.5]


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines, dup = text.split("\n"), 0
    for i, line in enumerate(lines):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_base_counts_match_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", "c d", " ", "\n", "\t", "é", "\x1c", "\xa0", "#", "|<", "a b c "]) for _ in range(rng.randint(0, 60)))
        assert quality_rules.base_counts(text) == brute_counts(text)


def test_distance():
    p, q = np.array([[1.0, 0], [5.0, 0], [0.0, 0], [0, 2.0]]), np.array([0, 3.0])
    assert quality_rules.js_distances(p, q).tolist() == [1, 1, 0, 0] and quality_rules.js_distances(p, 0 * q).tolist() == [0] * 4


def brute_distance(p, q):
    if not sum(p) or not sum(q):
        return 0.0
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    d = sum(a * math.log2(2 * a / (a + b)) for a, b in zip(p, q) if a) + sum(b * math.log2(2 * b / (a + b)) for a, b in zip(p, q) if b)
    return math.sqrt(max(d / 2, 0))


def test_distances_and_verdicts_match_brute_force(spark, monkeypatch):
    """References from whole lists of words, without parts, candidates or batches; a language with few documents has none."""
    monkeypatch.setattr(quality_rules, "COMMON_SHARE", 0.02)
    monkeypatch.setattr(quality_rules, "HELD_WORDS", 30)
    rng = random.Random(11)
    pool = {"aa": ["the", "of", "And", "to", *speech(rng, "abc", 40).split()], "bb": ["le", "la", "ÉT", *speech(rng, "xyz", 40).split()]}
    rows = []
    for i in range(160):
        lang = "aa" if i % 2 else "bb"
        n = rng.choice([0, 20, 60, 90])
        rows.append((i, " ".join(rng.choice(pool[lang][: rng.choice([4, 44])]) for _ in range(n)), rng.choice([lang] * 9 + [None]), "s"))
    rows += [(200 + i, " ".join(speech(rng, "pqr", 60).split()), "rare", "s") for i in range(5)]
    found = quality_rules.judge(documents(spark, rows).repartition(3)).toPandas().set_index("doc_id")
    assert found.columns.tolist() == ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"]
    refs = {}
    for lang in ("aa", "bb"):
        own = [t for _, t, x, _ in rows if x == lang and t]
        good = [t for t in own if (c := brute_counts(t))[0] >= 50 and 100 * c[4] <= 50 * c[0]]
        share, reference, classes = {}, {}, np.zeros(11)
        for texts, into in ((own, share), (good, reference)):
            for t in texts:
                words = re.sub("[A-Z]", lambda m: m[0].lower(), t).split()
                for w in words:
                    into[w] = into.get(w, 0) + 1 / len(words) / len(texts)
        for t in good:
            classes += quality_rules.char_histogram(t.encode()) / len(t.encode())
        common = sorted(w for w in share if share[w] >= 0.02)
        if len(good) >= quality_rules.LEAST_DOCS:
            refs[lang] = (classes, common, [reference.get(w, 0) for w in common])
    for i, text, lang, _ in rows:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text).split()
        each = []
        for name, (classes, common, weights) in refs.items():
            if lang == name or lang not in refs:
                own = [words.count(w) for w in common]
                each.append((brute_distance(quality_rules.char_histogram(text.encode()).tolist(), classes.tolist()), brute_distance([*own, len(words) - sum(own)], [*weights, 1 - sum(weights)])))
        want = min(each, key=max, default=(0, 0))
        row = found.loc[i]
        assert abs(row.char_distance - want[0]) < 1e-4 and abs(row.word_distance - want[1]) < 1e-4
        failed = len(words) < 50 or 100 * brute_counts(text)[4] > 50 * len(words)
        bad = (len(text.encode()) >= quality_rules.MIN_BYTES and want[0] > quality_rules.MAX_CHAR_DISTANCE) or (len(words) >= quality_rules.MIN_WORDS and want[1] > quality_rules.MAX_WORD_DISTANCE)
        assert row.base_failed == failed and row.kept == (not failed and not bad)


def test_quality_rules(spark, tmp_path):
    rng = random.Random(6)
    common = "the of and to in is that for it was on".split()
    clean = lambda: " ".join(rng.choice(common) if rng.random() < 0.5 else speech(rng, "abcdefghijkl", 1) for _ in range(120))
    rows = [(i, clean(), "aa", "s") for i in range(150)]
    rows += [(200, clean().upper(), "aa", "s"), (201, clean().replace(" ", "### "), "aa", "s"), (202, "w " * 200, "aa", "s"), (203, speech(rng, "mnopqr", 200), "aa", "s")]
    rows += [(204, None, None, None), (205, "few words", "aa", "s"), (206, clean(), None, None), (207, clean(), "unseen", "s"), (208, clean() * 300, "aa", "s")]
    found = quality_rules.op6_quality_rules(spark, written(documents(spark, rows), tmp_path)).toPandas().set_index("doc_id").sort_index()
    assert found.loc[:149, "kept"].all() and found.loc[[206, 207], "kept"].all()
    assert not found.loc[[200, 201, 202, 203, 204, 205, 208], "kept"].any()
    assert found.loc[[202, 204, 205, 208], "base_failed"].all() and not found.loc[[200, 201, 203], "base_failed"].any()
    assert quality_rules.judge(documents(spark, ["x"]).limit(0)).count() == 0
