"""Held-out accuracy and hard rows."""

import random

import numpy as np

from barloom.llm import language

SYLLABLES = {"aa": ["the", "ing", "and", "ow"], "bb": ["sch", "ein", "der", "ung"], "cc": ["que", "eau", "ment", "é"]}


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_held_out_accuracy(spark):
    train = spark.createDataFrame(corpus(200, 1), "doc_id long, text string, lang string")
    test = spark.createDataFrame(corpus(200, 2), "doc_id long, text string, lang string")
    model = language.fit(train)
    assert model.names == ["aa", "bb", "cc"]
    rows = language.classify(test, model).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 198
    assert all(0 <= r.score <= 1 for r in rows)
    again = language.fit(train.repartition(5))
    assert np.array_equal(model.profiles, again.profiles)


def test_bundles_are_sums_of_bound_vectors():
    vectors = language.Vectors(64)
    grams, counts = language.trigrams("Ab a?")
    letter = {c: vectors.letter(ord(c)) for c in "ab "}
    total = sum(
        np.roll(letter[a], 2).astype(int) * np.roll(letter[b], 1) * letter[c] for a, b, c in zip(" ab a", "ab a ", "b a ", strict=False)
    )
    assert np.array_equal(vectors.bundle(grams, counts), total)


def test_hard_rows(hard, empty):
    model = language.fit(hard)
    out = language.classify(hard, model)
    assert out.count() == hard.count() and out.columns.count("score") == 1
    for row in out.collect():
        if not any(c.isalpha() for c in row.text or ""):
            assert (row.lang_pred, row.score) == ("und", 0.0)
    nothing = language.fit(empty)
    assert nothing.names == []
    assert {r.lang_pred for r in language.classify(hard, nothing).collect()} == {"und"}
    assert language.classify(empty, model).count() == 0


def by_hand(texts):
    """The bundle of texts in loops: letters' vectors, permuted by place, multiplied, and added up."""
    total = np.zeros(language.DIMENSIONS)
    for text in texts:
        letters = "".join(c if c.isalpha() else " " for c in text.lower())
        padded = f" {' '.join(letters.split())} "
        if padded.strip():
            for i in range(len(padded) - 2):
                bound = np.ones(language.DIMENSIONS)
                for place, c in enumerate(padded[i : i + 3]):
                    bits = np.random.default_rng([11, ord(c)]).integers(0, 2, language.DIMENSIONS, dtype=np.int8)
                    bound *= np.roll(bits * 2.0 - 1.0, 2 - place)
                total += bound
    return total


def unit(x):
    return x / max(np.linalg.norm(x), 1e-12)


def test_profiles_and_scores_equal_the_definition(spark):
    rows = corpus(40, 3) + [(90, None, "aa"), (91, "12 --", "bb"), (92, "Ünï 'ça", "cc"), (93, "the", None)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    bundles = [unit(by_hand([t for _, t, lang in rows if lang == name and t])) for name in ("aa", "bb", "cc")]
    shared = sum(bundles) / 3
    profiles = [unit(b - shared) for b in bundles]
    assert model.names == ["aa", "bb", "cc"] and np.allclose(model.profiles, profiles, atol=1e-9)
    tests = [(1, "The owing thing"), (2, "schein und der"), (3, "x"), (4, "ÉAU que 12"), (5, None), (6, "...")]
    for row in language.classify(spark.createDataFrame(tests, "doc_id long, text string"), model).collect():
        own = by_hand([row.text or ""])
        if not own.any():
            assert (row.lang_pred, row.score) == ("und", 0.0)
            continue
        near = [float(p @ unit(unit(own) - shared)) for p in profiles]
        assert row.lang_pred == model.names[int(np.argmax(near))]
        assert abs(row.score - min(1.0, max(0.0, max(near)))) < 1e-6
