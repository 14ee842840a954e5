"""What counts as the same licence text."""

from barloom.llm import licences

KNOWN = [("MIT", "Permission is granted, free of charge, under this Licence."), ("Z", "No warranty & no non-commercial use.")]


def scan(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame(KNOWN, "licence string, text string")
    return {r.doc_id: r for r in licences.scan(docs, known).collect()}


def test_same_licence_in_other_clothes(spark):
    rows = scan(spark, [
        "permission is granted -- FREE of charge -- under this license",
        "Copyright (c) 2020 Someone\n\nPermission is granted,\n  free of charge, under this License.\n© Other",
        "Permission is granted, for a charge, under this License.",
        "Some text.\nNo warranty; no noncommercial use\nPermission is granted, free of charge, under this licence!\nmore",
    ])
    assert [rows[i].licence for i in range(4)] == ["MIT", "MIT", None, None]
    assert rows[0].digest == rows[1].digest != rows[2].digest
    assert [rows[i].notices for i in range(4)] == ["MIT", "", "", "MIT,Z"]


def test_neighbouring_spellings_are_all_replaced(spark):
    rows = scan(spark, ["licence licence licence", "license license license"])
    assert rows[0].digest == rows[1].digest


def test_hard_rows(spark, hard, empty):
    known = spark.createDataFrame([*KNOWN, ("none", None), ("blank", " .. "), (None, "x")], "licence string, text string")
    rows = licences.scan(hard, known).collect()
    assert len(rows) == hard.count()
    assert {r.digest for r in rows if r.doc_id in (3, 4, 5)} == {None} and {r.licence for r in rows} == {None}
    assert licences.scan(empty, known).count() == 0
    assert licences.scan(hard, known.limit(0)).count() == hard.count()


def test_common_licences_and_headers_are_known(spark):
    """Texts as files have them, with and without their title and a line that reserves all rights."""
    mit = next(t for name, t in licences.KNOWN if t.startswith("MIT License Permission")).removeprefix("MIT License ")
    by = "Copyright (c) 2020 Someone\n"
    texts = licences.licence_texts
    bsd = texts.bsd(3)[0].replace(" 2. ", "\n\n2. ").replace(" 3. ", "\n\n3. ")
    cases = [
        (by + "\n" + mit, "MIT"), ("The MIT License (MIT)\n\n" + by + mit, "MIT"), (by + "All rights reserved.\n\n" + mit, "MIT"),
        ("BSD 3-Clause License\n\n" + by + "All rights reserved.\n\n" + bsd, "BSD-3-Clause"), (by + texts.bsd(2)[1], "BSD-2-Clause"),
        (by + texts.ZLIB.replace("as-is", "'as-is'"), "Zlib"), (texts.UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>", "Unlicense"),
        (texts.APACHE + texts.APACHE_APPENDIX.replace("[yyyy]", "2020").replace("[name of copyright owner]", "Someone"), "Apache-2.0"),
        (by + texts.APACHE_HEADER, "Apache-2.0"), (by + texts.GPL_3[0], "GPL-3.0"), (texts.GPL_2[0], "GPL-2.0"), (mit + " But not on Sundays.", None),
    ]
    docs = spark.createDataFrame([(n, text) for n, (text, _) in enumerate(cases)], "doc_id long, text string")
    known = spark.createDataFrame(licences.KNOWN, "licence string, text string")
    got = {r.doc_id: r.licence for r in licences.scan(docs, known).collect()}
    assert [got[n] for n in range(len(cases))] == [name for _, name in cases]
