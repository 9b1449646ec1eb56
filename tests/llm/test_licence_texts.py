"""Licence texts and headers as they stand in real trees."""

import textwrap

from pyspark.sql import functions as F

from lumenframe.llm import licenses


def text_of(name):
    return (licenses.TEXTS / f"{name}.txt").read_text()


def wrapped(name, prefix="", width=60, title=True):
    paragraphs = [textwrap.fill(p.replace("<copyright holders>", "Ann Example and others").replace("<year>", "2019"), width) for p in text_of(name).split("\n\n")]
    return "\n".join((prefix + x).rstrip() for x in "\n\n".join(paragraphs if title else paragraphs[1:]).split("\n"))


GPL = "\n\n".join(licenses.HEADERS["GPL-3.0"][0])
CODE = "\n".join(f"int f{i}(int x) {{ return x * {i}; }}" for i in range(200))
PROSE = "The court said that the licence of the driver had lapsed and that the copyright of the song was not in dispute. " * 5


def test_texts_and_headers(spark):
    gpl = "\n".join(f" * {x}".rstrip() for x in textwrap.fill(licenses.HEADERS["GPL-3.0"][0][0], 60).split("\n"))
    whole = "\n".join(f"# {x}".rstrip() for p in licenses.HEADERS["LGPL-2.1"][0] for x in [*textwrap.fill(p, 60).split("\n"), ""])
    apache = "\n".join(f"// {x}".rstrip() for p in licenses.HEADERS["Apache-2.0"][0] for x in [*textwrap.fill(p, 60).split("\n"), ""])
    rows = [
        (1, "bsd2/LICENSE", wrapped("BSD-2-Clause")), (2, "bsd3/LICENSE.txt", wrapped("BSD-3-Clause")), (3, "mit/LICENSE", wrapped("MIT", title=False)), (4, "mit/src/deep/a.c", CODE),
        (5, "g/a.c", f"/*\n{gpl}\n */\n{CODE}"), (6, "g/b.py", f"#!/bin/sh\n{whole}\n{CODE}"), (7, "g/c.go", f"{apache}\npackage c // license\n{CODE}"), (8, "g/d.c", CODE), (9, "t/COPYING", text_of("GPL-3.0")),
        (10, "t2/COPYING", text_of("GPL-2.0")), (11, "t3/LICENSE", text_of("LGPL-2.1").replace("\n", "\r\n")), (12, "p/law.txt", PROSE), (13, "bsd2/x.c", CODE), (14, "h/isc.js", f"/*\n{wrapped('ISC', ' * ', title=False)}\n */\n{CODE}"),
        (15, "u/LICENSE", text_of("Apache-2.0")), (16, "u2/LICENSE", text_of("MPL-2.0")), (17, "u3/LICENSE", text_of("CC0-1.0")),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["license"], r["how"]) for r in licenses.license_scan(files).collect()}
    want = {
        1: ("BSD-2-Clause", "licence_file"), 2: ("BSD-3-Clause", "licence_file"), 3: ("MIT", "licence_file"), 4: ("MIT", "inherited"), 5: ("GPL-3.0", "header"), 6: ("LGPL-2.1", "header"),
        7: ("Apache-2.0", "header"), 8: (None, "none"), 9: ("GPL-3.0", "licence_file"), 10: ("GPL-2.0", "licence_file"), 11: ("LGPL-2.1", "licence_file"), 12: (None, "none"), 13: ("BSD-2-Clause", "inherited"),
        14: ("ISC", "header"), 15: ("Apache-2.0", "licence_file"), 16: ("MPL-2.0", "licence_file"), 17: ("CC0-1.0", "licence_file"),
    }
    assert got == want


def test_a_short_file_with_a_header_is_no_licence_file(spark):
    rows = [(1, "a/x.py", "# Licensed under the Apache License, Version 2.0.\n" + "word " * 60), (2, "a/y.py", "words"), (3, "b/LICENSE", "Released under the MIT License.\n" + "word " * 200), (4, "b/c/y.py", "words")]
    got = {r["doc_id"]: (r["license"], r["how"]) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("Apache-2.0", "header"), 2: (None, "none"), 3: ("MIT", "licence_file"), 4: ("MIT", "inherited")}


def test_blocks_keep_comments_apart(spark):
    files = spark.createDataFrame([(1, "# a license\n# of two lines\ncode = 1\n\nmore\n\n(c) copyright x\n\ncopyright y")], "key long, text string")
    blocks = {r["line"].strip() for r in licenses.licence_blocks(files).where(F.length("line") < 40).collect()}
    assert "# a license\n# of two lines" in blocks and "(c) copyright x" in blocks and any(x.startswith("(c) copyright x") and x.endswith("copyright y") for x in blocks)
