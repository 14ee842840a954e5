"""Fingerprints, their likeness and the order of documents."""

import hashlib
import random

from barloom.llm import order_minhash as omh


def text_of(fp):
    return fp.astype(">u4").tobytes().hex()


def check(df, order):
    """``order`` has the (doc_id, text) in the order in which they follow each other."""
    got = sorted(map(tuple, omh.fingerprints(df).collect()), key=repr)
    wanted = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        changed = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        own, other = omh.fingerprint(text), omh.fingerprint(changed)
        wanted.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), text_of(own), text_of(other),
                       omh.likeness(own, other), omh.likeness(own, omh.fingerprint(after))))
    assert got == sorted(wanted, key=repr)


def test_every_document_meets_the_next(spark):
    rng = random.Random(4)
    rows = [(i * 3 % 101, "".join(rng.choice("ab cd") for _ in range(rng.randint(0, 90)))) for i in range(101)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), sorted(rows, key=lambda r: -r[0]))


def test_hard_rows(spark, hard, empty):
    rows = [(r.doc_id, r.text or "") for r in hard.collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    check(hard, order)
    assert omh.fingerprints(empty).count() == 0
    lone = spark.createDataFrame([(1, "alone")], "doc_id long, text string")
    check(lone, [(1, "alone")])


def test_likeness_falls_with_edits_and_with_order():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    text = " ".join(words)
    own = omh.fingerprint(text)
    few, many = ([w if rng.random() > p else "changed" for w in words] for p in (0.02, 0.3))
    turned = " ".join(words[150:] + words[:150])
    shuffled = words[:]
    rng.shuffle(shuffled)
    likeness = [omh.likeness(own, omh.fingerprint(t)) for t in (text, " ".join(few), " ".join(many), " ".join(shuffled))]
    assert likeness == sorted(likeness, reverse=True) and likeness[0] == 1 and likeness[1] > 0.5 and likeness[3] < 0.1
    # The same k-mers in another order are less alike, which a set of k-mers would not notice.
    assert omh.likeness(own, omh.fingerprint(turned)) < 0.8


def test_repeats_are_numbered():
    assert len(set(omh.numbered_kmers("ab" * 50).tolist())) == 100 - omh.KMER + 1
    assert len(omh.numbered_kmers("")) == 0 and len(omh.numbered_kmers("abc")) == 1
    once, twice = omh.numbered_kmers("abcdefghijkl"), omh.numbered_kmers("abcdefghijkl" * 2)
    assert set(once.tolist()) <= set(twice.tolist())


M64 = (1 << 64) - 1


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M64
    return x ^ (x >> 31)


def plain_fingerprint(text):
    """The definition in loops: rank all numbered k-mers, take the lowest few, put them in the text's order."""
    kmers = omh.numbered_kmers(text).tolist()
    names = [text[i : i + omh.KMER] for i in range(max(1, len(text) - omh.KMER + 1))] if text else []
    seen, numbered = {}, []
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        numbered.append((name, seen[name]))
    # The hashes stand for the numbered k-mers, and for nothing else.
    assert len(numbered) == len(kmers) and len(set(zip(numbered, kmers, strict=True))) == len(set(numbered)) == len(set(kmers))
    out = []
    for factor, shift in zip(omh._FACTORS.tolist(), omh._SHIFTS.tolist(), strict=True):
        ranked = sorted((((k >> 32) * factor + shift) % (1 << 32), at) for at, k in enumerate(kmers))
        chosen = sorted(at for _, at in ranked[: omh.TUPLE])
        parts = [0] * (omh.TUPLE - len(chosen)) + [kmers[at] for at in chosen]
        value = 0
        for part in parts:
            value = mixed((value * 0x9E3779B97F4A7C15 + part + 1) & M64)
        out.append(value >> 32)
    return out


def test_fingerprints_equal_the_definition():
    rng = random.Random(11)
    texts = ["", "a", "abcdefgh", "aaaaaaaaaaaaaaaaaaaa", "ab" * 700]
    texts += ["".join(rng.choice("abc 😀é") for _ in range(rng.randint(1, 400))) for _ in range(25)]
    texts.append("".join(rng.choice("abcdefgh ") for _ in range(2 * omh.BLOCK + 77)))
    for text in texts:
        assert omh.fingerprint(text).tolist() == plain_fingerprint(text)
