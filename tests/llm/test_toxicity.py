"""Held-out accuracy, located sentences and hard rows."""

import math
import random
from types import SimpleNamespace

from barloom.llm import toxicity


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    plain = [a + b for a in ("ta", "mo", "re", "li", "su") for b in ("ba", "ne", "ko", "ri", "du", "fa")]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        sentences = [" ".join(rng.choice(plain) for _ in range(6)) for _ in range(rng.randint(2, 9))]
        if toxic:
            sentences[rng.randrange(len(sentences))] += f" {rng.choice(['vilewort', 'foulname'])}{rng.choice('abc')}"
        rows.append((i, ". ".join(sentences)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learns_from_documents_and_points_at_sentences(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame(labels[:300], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, marked)).collect()
    truth, texts = dict(labels), dict(rows)
    for row in out:
        if row.doc_id >= 300:
            assert (row.score >= 0.5) == bool(truth[row.doc_id])
        for span in row.offending:
            assert "vile" in texts[row.doc_id][span.start : span.end] or "foul" in texts[row.doc_id][span.start : span.end]


def test_sentences_cover_the_text():
    assert list(toxicity.sentence_spans("One. Two!\nThree")) == [(0, 3), (4, 8), (10, 15)]
    assert list(toxicity.sentence_spans("")) == [] and list(toxicity.sentence_spans("...")) == []


def test_hard_rows(spark, hard, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (6, 0), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(hard, labels)
    out = toxicity.score(hard, model)
    assert out.count() == hard.count() and out.columns.count("score") == 1
    assert all(0 <= r.score <= 1 for r in out.collect())
    none = toxicity.fit(empty, labels)
    assert none.weights == {} and toxicity.score(hard, none).filter("score > 0").count() == 0
    assert toxicity.score(empty, model).count() == 0


def test_scores_are_a_noisy_or_of_sentences(spark):
    """One less the product, over the sentences with a known word, of the chance that each is clean."""
    text = "A vile thing. nothing here! vile and foul\nfoul foul foul. odd"
    words = {x for start, end in toxicity.sentence_spans(text) for x in toxicity.features(text[start:end])}
    vile, foul = (next(x for x in sorted(words) if name in x and len(x.split()) == 1) for name in ("vile", "foul"))
    model = toxicity.ToxicityModel({vile: 1.5, foul: -0.4}, -0.7)
    odds = [-0.7 + 1.5, -0.7 + 1.5 - 0.4, -0.7 - 0.4]
    clean = 1.0
    for z in odds:
        clean *= 1 - 1 / (1 + math.exp(-z))
    row = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert abs(row.score - (1 - clean)) < 1e-12
    assert [(text[s.start : s.end].strip(), round(s.score, 9)) for s in row.offending] == [
        (part, round(1 / (1 + math.exp(-z)), 9)) for part, z in zip(["A vile thing", "vile and foul"], odds, strict=False)
    ]


def test_training_raises_the_likelihood_of_the_labels():
    """The trained weights beat weights that are off, by the penalised likelihood worked out in loops."""
    rng = random.Random(6)
    rows = []
    for i in range(120):
        toxic = i % 3 == 0
        bag = [[rng.randrange(3)] if rng.random() < 0.5 else [1, 2] for _ in range(rng.randint(1, 4))]
        rows.append(SimpleNamespace(toxic=int(toxic or rng.random() < 0.1), sentences=bag + [[0, 1]] * toxic, times=[1] * (len(bag) + toxic)))
    weights, bias = toxicity._noisy_or_fit(rows, 3)

    def loss(values):
        total = sum(v * v for v in values) / (2 * toxicity.PRIOR**2)
        for row in rows:
            clean = sum(-math.log1p(math.exp(values[3] + sum(values[f] for f in own))) for own in row.sentences)
            total -= math.log(-math.expm1(clean)) if row.toxic else clean
        return total

    found = [*weights.tolist(), bias]
    for i in range(4):
        for step in (-0.5, 0.5):
            assert loss([v + step * (j == i) for j, v in enumerate(found)]) > loss(found)
