"""Components against brute force over all pairs."""

import random
import re

from barloom.llm import near_dup
from barloom.llm.components import connect


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """Rows (id, text) -> sorted (id, size, component, kept)."""
    named = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, s in named if i is not None and s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = [(i, s) for i, s in named if i in root and s]
    for n, (i, s) in enumerate(linked):
        for j, t in linked[:n]:
            if 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    out = []
    for i, s in named:
        component = find(i) if s and i is not None else i
        out.append((i, len(s), component, i is None or i == component))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in near_dup.near_duplicates(df).collect()), key=repr)


def families(seed, families=4, members=40):
    """Families of near copies around the threshold, copies of both, a common passage and singles."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage, rows = [word() for _ in range(40)], []
    for _ in range(families):
        base = [word() for _ in range(80)]
        for _ in range(members):
            own, edits = base[:], rng.randint(0, 9)
            for _ in range(edits):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
    rows += [" ".join([word() for _ in range(rng.randint(3, 30))] + passage) for _ in range(40)]
    rows += rng.choices(rows, k=60)
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_components_match_brute_force(spark):
    for seed in (1, 2):
        rows = families(seed)
        result = got(spark.createDataFrame(rows, "doc_id long, text string"))
        assert result == brute(rows)
        assert 1 < len({r[2] for r in result}) < len(rows) - 60


def test_hard_rows(hard, empty):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    assert got(hard) == brute(rows)
    assert near_dup.near_duplicates(empty).count() == 0
    kept = near_dup.drop_near_duplicates(hard)
    assert kept.columns == hard.columns
    assert sorted((r.doc_id or -1 for r in kept.collect())) == [-1, -1, 1, 3, 4, 5, 6, 7, 8]


def test_one_id_with_two_texts_joins_their_groups(spark):
    a, b = ("one two three four five six", "red green blue black white grey")
    rows = [(1, a), (5, a), (5, b), (9, b)]
    assert {r[2] for r in got(spark.createDataFrame(rows, "doc_id long, text string"))} == {1}


def test_case_and_short_texts(spark):
    rows = [(1, "Ab CD"), (2, "aB  cd"), (3, "ab cd ef"), (4, "É ab"), (5, "é ab"), (6, "ef")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_connect_finds_the_smallest_vertex(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 202), (200, 202)]
    links = spark.createDataFrame(path, "u long, v long")
    found = {r.u: r.v for r in connect(links).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, 95: 90, 100: 90, 201: 200, 202: 200}
