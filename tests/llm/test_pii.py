"""Base spans against a brute-force reading of the patterns, and what the votes add."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from barloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "card":
        total = sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return True


def brute(text):
    spans = [
        (m.start(), n, m.end(), kind)
        for n, (kind, pattern) in enumerate(PLAIN.items())
        for m in re.finditer(pattern, text or "")
        if passes(kind, m.group())
    ]
    return [f"{kind}:{start}:{end}" for start, _, end, kind in sorted(spans)]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.find(df).select("doc_id", pii.describe(F.col("spans")).alias("s")).collect()
    return [r.s.split(",") if r.s else [] for r in sorted(rows)]


def test_base_spans_match_brute_force(spark):
    rng = random.Random(3)
    alphabets = ["aA0123456789.@+-_() \n%é😀b", "0123456789.@+- "]
    texts = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a@b.c_d@e.f x@y.z@q.r", "300.1.1.1.1 1.2.3.4.5.6.7.8", "4111 1111 1111 1111, 4111-1111-1111-1111-1", None]
    got = found(spark, texts)
    base = [[s for s in spans if s.split(":")[0] in PLAIN] for spans in got]
    assert base == [brute(text) for text in texts]
    assert sum(map(bool, base)) > 20


def test_long_runs_take_no_longer_than_their_length(spark):
    texts = ["5" * 3000 + "a" * 100_000 + "@", "1." * 20_000, "a@b" + ".c" * 50_000, "+1" + " ()" * 30_000 + "2"]
    assert [len(s) for s in found(spark, texts)] == [len(brute(t)) for t in texts]


def test_context_decides_on_further_kinds(spark):
    said = "my phone (212) 555-0123 and SSN 123-45-6789; Mr. John Smith"
    silent = "the lot (212) 555-0123 of part 123-45-6789 for Upper Street"
    got = found(spark, [said] * 8 + [silent])
    assert got[0] == ["local_phone:9:23", "ssn:32:43", "person:49:59"]
    assert got[-1] == []


def test_context_reaches_across_earlier_hits(spark):
    texts = ["SSN: 123-45-6789, 234-56-7890", "call 212-555-0123 or 212-555-0199", "Übung 😀 SSN 123-45-6789, 234-56-7890"]
    got = found(spark, texts * 3)
    assert got[0] == ["ssn:5:16", "ssn:18:29"]
    assert got[1] == ["local_phone:5:17", "local_phone:21:33"]
    assert got[2] == ["ssn:12:23", "ssn:25:36"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    votes = pii.candidates(docs).select(F.explode("_candidates.cue").alias("cue")).collect()
    assert [r.cue for r in votes] == [pii.YES] * 6


def test_the_classifier_can_decide_without_a_cue(spark):
    """Where most data stands without a cue, its absence says little."""
    mails = ["a@b.com", "x c.d@e.org y"] * 20
    bare = ["| Ann | DE89 3704 0044 0532 0130 00 | 12 |", "row 1, 212-555-0123, x", "x 123-45-6789", "the Apache License"]
    got = found(spark, mails + bare)
    assert got[-4:] == [["iban:8:35"], ["local_phone:7:19"], ["ssn:2:13"], []]


def test_redaction_and_hard_rows(spark, hard, empty):
    df = spark.createDataFrame([(1, "mail a@b.co or 4111111111111111 now", "v")], "doc_id long, text string, spans string")
    assert pii.redact(df).select("text").first().text == "mail [EMAIL] or [CARD] now"
    out = pii.redact(hard)
    assert out.count() == hard.count() and out.columns == [c for c in hard.columns if c != "spans"]
    assert pii.find(empty).count() == 0
    kept = {r.doc_id: r.text for r in out.collect() if r.doc_id}
    assert kept[3] is None and kept[4] == "" and kept[7] == "x" * 50_000


def test_unreliable_labelers_lose_weight():
    """A labeler that agrees with the others gets more weight than one that says yes to everything."""
    counts = [("ssn", (1, 1, 1, -1), 100), ("ssn", (0, 1, -1, 0), 100), ("ssn", (0, 1, -1, -1), 50), ("ssn", (1, 1, -1, -1), 20)]
    votes = pii.fit(counts).votes
    assert votes["strict"][1] - votes["strict"][0] > 1
    assert abs(votes["listed"][1]) < votes["strict"][1] - votes["strict"][0]


def test_digest_of_no_spans(spark):
    df = spark.createDataFrame([(1, "nothing")], "doc_id long, text string")
    row = pii.find(df).select(F.sha2(pii.describe(F.col("spans")), 256).alias("d")).first()
    assert row.d == hashlib.sha256(b"").hexdigest()


def test_running_folds_equal_a_loop(spark):
    for n in (0, 1, pii.RUN - 1, pii.RUN, pii.RUN + 1, 3 * pii.RUN, 1000):
        values = [(7 * i) % 11 for i in range(n)]
        df = spark.createDataFrame([(values,)], "v array<int>")
        got = df.select(pii._running(F.col("v"), lambda a, x: a + x, F.lit(0)).alias("r")).first().r
        assert got == [sum(values[:i]) for i in range(n + 1)]


def test_many_spans_in_one_text_cost_what_they_are(spark):
    """A text of contacts: a fold that copied its spans would take minutes here."""
    text = " ".join(f"u{i}@b.co John Smith" for i in range(30_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.monotonic()
    clean = pii.redact(df).first().text
    assert time.monotonic() - start < 60
    assert clean.count("[EMAIL]") == 30_000 and "@" not in clean


def test_spans_over_runs_and_blocks(spark):
    rng = random.Random(8)
    tokens = ["a@b.co", "x.y@z.org", "123-45-6789", "+1 212 555 0199", "John Smith", "10.0.0.1", "4111 1111 1111 1111", "SSN", "😀é", "\n", "w" * 90]
    texts = ["".join(rng.choice(tokens) + rng.choice(" -@.") for _ in range(n)) for n in (5, 200, 900, 2500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.find(df).withColumn("clean", pii.redacted(F.col("text"), F.col("spans"))).orderBy("doc_id").collect()
    for row, text in zip(rows, texts, strict=True):
        spans = [(s.start, s.end, pii.KINDS[s.kind]) for s in row.spans]
        assert [f"{k}:{a}:{b}" for a, b, k in spans if k in PLAIN] == brute(text)
        base = [(a, b) for a, b, k in spans if k in PLAIN]
        assert not any(a < end and start < b for a, b, k in spans if k not in PLAIN for start, end in base)
        out, at = "", 0
        for a, b, kind in spans:
            if a >= at:
                out += text[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        assert row.clean == out + text[at:]
