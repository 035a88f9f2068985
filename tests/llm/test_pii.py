import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from trawlframe.llm import pii

from .helpers import documents, written

RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute(text):
    out = []
    for k, (name, rule) in enumerate(RULES):
        for m in re.finditer(rule, text or "", re.ASCII):
            digits = [int(c) for c in m[0] if c.isdigit()]
            if name == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if name == "card":
                total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
                if not 14 <= len(digits) <= 19 or total % 10:
                    continue
            if name == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_base_spans_match_brute_force(spark, tmp_path):
    rng = random.Random(1)
    parts = ["a@b.c", "@", "x.y+z@host.example.org", "+x@d.e", "1.2.3.4", ".5", "999.1.1.1", "00255.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (736) 555-2678", "+", " ", "é", "\n", "-", "_", "12", "+49((((", "a.b.c", "..", "5500005555555559", "+12 345 678 901 2"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    texts += [None, "", "a.b" * 30_000 + "@" + "c." * 20_000, "1." * 60_000, "9" * 100_000, "+1" + "(" * 50_000, "😀 a@b.c 😀 1.2.3.4"]
    folder = written(documents(spark, texts), tmp_path)
    found = pii.op4_pii(spark, folder).toPandas().set_index("doc_id")
    for i, text in enumerate(texts):
        want = brute(text)
        got = ",".join(s for s in found.loc[i, "spans"].split(",") if not s.startswith(("term", "secret")))
        assert got == want, (text or "")[:200]
        assert found.loc[i, "base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def corpus():
    rows = [f"Report number {i} was written by somebody ordinary about matters {w}" for i, w in enumerate(["rain", "snow", "wind", "heat"] * 30)]
    rows += [f"Ask Zaphodius about {x} at zaph@example.org or elsewhere please" for x in ("ships", "stars", "tea")]
    rows += ["Write to zaph@example.org", "Zaphodius stood here without an address about"]
    return rows


def test_terms_that_disclose(spark, tmp_path):
    folder = written(documents(spark, corpus()), tmp_path)
    found = pii.op4_pii(spark, folder).toPandas()
    hit = found[found.n_term > 0]
    assert sorted(hit.doc_id) == [120, 121, 122]
    for doc_id, spans in zip(hit.doc_id, hit.spans):
        words = {corpus()[doc_id][int(a) : int(b)].lower() for k, a, b in (s.split(":") for s in spans.split(",")) if k == "term"}
        assert "zaphodius" in words and "about" not in words


def test_sanitized_keeps_columns_and_other_rows(spark):
    docs = documents(spark, [*corpus(), None]).withColumn("spans", F.lit("own")).withColumn("uid", F.lit(1))
    out = {r.doc_id: r for r in pii.sanitized(docs).collect()}
    assert len(out) == len(corpus()) + 1 and out[0].spans == "own"
    assert out[0].text == corpus()[0] and out[len(corpus())].text is None
    assert "[EMAIL]" in out[123].text and "zaph@" not in out[121].text and "[NAME]" in out[121].text


def test_copies_are_one_context(spark, tmp_path):
    rows = ["ordinary words without anything in them"] * 50 + ["Unusualname wrote from one@example.org today"] * 5
    found = pii.op4_pii(spark, written(documents(spark, rows), tmp_path)).toPandas()
    assert found.n_term.sum() == 0 and found.n_email.sum() == 5


def test_terms_far_from_the_entity_go_everywhere(spark):
    filler = "Report number so says on was written by somebody ordinary about matters rain snow wind heat " * 4
    rows = [f"{filler}{i}" for i in range(60)]
    rows += [f"Zaphodius on {x}. {filler} zaph@example.org {filler} So says zaphodius" for x in ("ships", "stars")]
    rows += ["Zaphodius without an address"]
    out = {r.doc_id: r.text for r in pii.sanitized(documents(spark, rows)).collect()}
    for i, x in ((60, "ships"), (61, "stars")):
        assert out[i].startswith(f"[NAME] on {x}. Report") and out[i].endswith("[WORD]") and "[EMAIL]" in out[i]
    assert out[62] == rows[62] and out[0] == rows[0]


def test_near_copies_are_one_context(spark, tmp_path):
    rng = random.Random(8)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    text = say(300) + " one@example.org " + say(100)
    copies = [text.replace(" ", f" edit{i} ", 1) for i in range(12)]
    others = [f"Quorl {say(120)} two@example.org {say(80)}" for _ in range(2)]
    rows = [say(60) for _ in range(80)] + copies + others
    found = pii.op4_pii(spark, written(documents(spark, rows), tmp_path)).toPandas().set_index("doc_id").sort_index()
    assert found["n_term"].tolist()[:92] == [0] * 92 and found["n_email"].sum() == 14
    assert all("term:0:5" in spans for spans in found["spans"][92:])


def test_contexts_with_the_same_smallest_place(spark, tmp_path):
    same = "Copied words before one@example.org and after them, which are long enough to fill what is looked at around it, and more than that. "
    rows = ["ordinary words without anything in them"] * 50
    rows += [f"{same}{' '.join(f'{w}{k}' for k in range(60))} Unusualname wrote {w} from one@example.org {w}" for w in ("today", "monday")]
    found = pii.op4_pii(spark, written(documents(spark, rows), tmp_path)).toPandas().set_index("doc_id")
    for i in (50, 51):
        words = {rows[i][int(a) : int(b)] for k, a, b in (s.split(":") for s in found.loc[i, "spans"].split(",")) if k == "term"}
        assert "Unusualname" in words


def brute_terms(rows):
    """(row, start, end, removed) of every disclosing term, from whole documents and their counts."""
    docs = [t or "" for t in rows]
    words = [{w.lower() for w in re.findall(r"[^\W_]{2,}", t)} for t in docs]
    entities = {}
    for i, t in enumerate(docs):
        for span in filter(None, brute(t).split(",")):
            kind, a, b = span.split(":")
            entities.setdefault((kind, t[int(a) : int(b)].lower()), set()).add(i)
    hits = {}
    for held in entities.values():
        for term in set().union(*(words[i] for i in held)):
            both = [i for i in held if term in words[i]]
            if len({frozenset(words[i]) for i in both}) < 2:  # copies; the rows have no other near copies
                continue
            df = sum(term in w for w in words)
            bits = math.log2(len(docs) / len(held))
            disclosure = math.log2(len(both) * len(docs) / (len(held) * df)) / bits if bits else 0
            if disclosure >= 0.5:
                for i in held:
                    hits[i, term] = max(disclosure, hits.get((i, term), 0))
    out = set()
    for i, t in enumerate(docs):
        base = [tuple(map(int, x.split(":")[1:])) for x in filter(None, brute(t).split(","))]
        for m in re.finditer(r"[^\W_]{2,}", t):
            if (i, m[0].lower()) in hits and not any(a < m.end() and m.start() < b for a, b in base):
                out.add((i, m.start(), m.end(), hits[i, m[0].lower()] >= 0.95))
    return out


def test_terms_match_brute_force(spark):
    rng = random.Random(4)
    names = ["Ann", "Zaphod", "李明", "Müller", "B7", "o", "the", "of"]
    entities = ["a@b.example", "z@b.example", "10.0.0.7", "+44 20 7946 0958"]
    rows = [None, "", "a@b.example"]
    for _ in range(90):
        words = [rng.choice(["rain", "snow", "wind", "heat", "of", "the"]) for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.3:
            k = rng.randrange(4)
            words += [entities[k], names[k] if rng.random() < 0.8 else rng.choice(names)]
        rng.shuffle(words)
        rows.append(" ".join(words))
    rows += rows[-5:]  # copies are one context
    docs = pii.materialize(documents(spark, rows), "rows")
    numbered = pii.numbered(docs, "row")
    found = pii.by_document(numbered, "row").join(numbered.select(F.col("row").alias("uid"), "doc_id"), "uid")
    got = {(r.doc_id, s.start, s.end, s.gone) for r in found.collect() for s in r.spans if s.kind == 5}
    want = brute_terms(rows)
    assert got == want and 10 < len(want) and any(x[3] for x in want) and not all(x[3] for x in want)


def test_secrets(spark, tmp_path):
    key = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"
    rows = [f'token = "{key}" and more', "a" * 60, "1" * 60, "donaudampfschifffahrtsgesellschaftskapitaen", "ab1" * 20, f"{key[:12]}", f"x{key}@host.example.org", "sk-" + "Ab9" + "xQ7Zt2LmP4vN8kRw" + "=" * 2]
    found = pii.op4_pii(spark, written(documents(spark, rows), tmp_path)).toPandas().set_index("doc_id").sort_index()
    assert found.columns.tolist() == ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_secret", "n_term", "n_removed", "n_spans"]
    assert found["n_secret"].tolist() == [1, 0, 0, 0, 0, 0, 0, 1] and found.loc[0, "spans"] == "secret:9:49"
    assert found.loc[0, "base_sha256"] == hashlib.sha256(b"").hexdigest() and found.loc[6, "n_email"] == 1
    out = {r.doc_id: r.text for r in pii.sanitized(documents(spark, rows)).collect()}
    assert out[0] == 'token = "[SECRET]" and more' and out[4] == rows[4]


def test_overlapping_spans_leave_nothing(spark):
    text = "call +4111 1111 1111 1111 now"  # a card inside a phone number's run
    out = pii.sanitized(documents(spark, [text, text])).collect()
    assert {r.text for r in out} <= {"call [PHONE] now", "call +[CARD] now"}


def test_repeated_ids_and_very_long_texts(spark, tmp_path):
    rows = [(1, "x@y.example Quorl"), (1, "Quorl again x@y.example"), (None, "nothing"), (2, "word1 " * 200_000 + "x@y.example"), (3, "plain")] + [(9, f"filler {i}") for i in range(40)]
    docs = documents(spark, rows).withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("kind", F.lit(1)).withColumn("start", F.lit(1))
    found = pii.op4_pii(spark, written(docs, tmp_path))
    assert found.count() == 45 and {(r.n_email, r.n_term) for r in found.filter("doc_id = '1'").collect()} == {(1, 1)}


def test_empty_table(spark, tmp_path):
    assert pii.op4_pii(spark, written(documents(spark, ["x"]).limit(0), tmp_path)).count() == 0
