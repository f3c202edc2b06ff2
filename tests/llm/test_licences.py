"""Licence digests: equal in canonical form, and nothing else."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marketspark.llm import licences


@pytest.fixture(scope="module")
def known(spark):
    return licences.known_licences(spark)


def found(docs, known):
    return {r["doc_id"]: r["licence"] for r in licences.find_licences(docs, known).collect()}


def test_every_known_text_finds_itself(docs_of, known):
    texts = list(licences.KNOWN.items())
    docs = docs_of(*[t for _, t in texts])
    assert found(docs, known) == {i: name for i, (name, _) in enumerate(texts)}


def test_what_does_not_matter(docs_of, known):
    mit = licences.KNOWN["MIT"]
    zlib = licences.KNOWN["Zlib"]
    docs = docs_of(
        "Copyright (c) 2020 Somebody, all rights reserved\n\n" + mit,
        "(C) 1999 A. Person\r\nCOPYRIGHT 2001 B. Person\r\n" + mit.replace("\n", "\r\n"),
        "\n".join("# " + line for line in mit.split("\n")),
        mit.upper().replace('"', "”"),
        mit.replace("sublicense", "sub-license").replace("copyright notice", "copyright  notice"),
        zlib.replace("1. ", "a) ").replace("2. ", "b) ").replace("acknowledgment", "acknowledgement"),
        " * " + mit.replace("\n", "\n * "),
        "© 2020 me\n" + licences.KNOWN["ISC"],
        "Licenced under the Apache License,   version 2.0",
    )
    assert found(docs, known) == {
        **dict.fromkeys(range(5), "MIT"),
        5: "Zlib",
        6: "MIT",
        7: "ISC",
        8: "Apache-2.0 notice",
    }


def test_what_does(docs_of, known):
    mit = licences.KNOWN["MIT"]
    docs = docs_of(
        mit + "\nWith one more condition.",
        mit.replace("without limitation", "with limitation"),
        "Some text. " + licences.KNOWN["MIT notice"],
        "Licensed under the Apache License, Version 2.1.",
        "The copyrights of the licence are favourable",
    )
    assert set(found(docs, known).values()) == {None}


def test_spellings_side_by_side(docs_of):
    docs = docs_of("license license favor", "licence licence favour", "non-commercial use", "noncommercial use")
    rows = docs.select("doc_id", licences.digest(F.col("text"))).collect()
    digest = dict(map(tuple, rows))
    assert digest[0] == digest[1] and digest[2] == digest[3] and digest[0] != digest[2]


def test_awkward_rows(spark, awkward, known):
    rows = licences.find_licences(awkward, known).collect()
    assert len(rows) == 8 and {r["licence"] for r in rows} == {None}
    assert {r["doc_id"] for r in rows if r["digest"] is None} == {2, 3, 4}
    assert licences.find_licences(awkward.limit(0), known).count() == 0
    twins = spark.createDataFrame([("b", "x y"), ("a", "X, y!"), ("c", ""), ("d", None)], "licence string, text string")
    docs = spark.createDataFrame([(1, "x Y"), (2, "")], "doc_id bigint, text string")
    assert found(docs, twins) == {1: "a", 2: None}


def test_whole_files(docs_of, known):
    mit, bsd = licences.KNOWN["MIT"], licences.KNOWN["BSD-2-Clause"]
    notice = "Copyright (c) 2020 X"
    marked = "Terms\n{} use it\n(c) {}"
    docs = docs_of(
        f"MIT License\n\n{notice}\n\n{mit}",
        f"The MIT License (MIT)\n{notice}\n{mit}",
        f"ISC License\n\n{notice}\n\n{licences.KNOWN['ISC']}",
        f"BSD 2-Clause License\n\n{notice}\nAll rights reserved.\n\n{bsd}",
        f'BSD 3-Clause "New" or "Revised" License\n{notice}\n' + licences.KNOWN["BSD-3-Clause"],
        f"{notice} " + mit.replace("\n", " "),
        marked.format("(b)", "you must share it"),
        marked.format("(b)", "you must not share it"),
    )
    names = found(docs, known)
    assert [names[i] for i in range(6)] == ["MIT", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "MIT"]
    digests = dict(docs.select("doc_id", licences.digest(F.col("text"))).collect())
    assert digests[6] != digests[7]
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"} <= set(licences.KNOWN)


def test_lines_and_paragraphs(docs_of, known):
    mit, notices = licences.KNOWN["MIT"], [licences.KNOWN[f"{n} notice"] for n in ("MIT", "GPL-3.0")]
    docs = docs_of(
        f"A long text.\nMore of it.\n{notices[0]}",
        f"{notices[1]}\r\nA text\r\n{notices[0].upper()}",
        f"Readme\n\n{mit}\n\nThe end.",
        f"A text. {notices[0]}",
    )
    rows = {r["doc_id"]: (r["licence"], r["inside"]) for r in licences.find_licences(docs, known).collect()}
    assert rows == {
        0: ("MIT notice", ["MIT notice"]),
        1: ("GPL-3.0 notice", ["GPL-3.0 notice", "MIT notice"]),
        2: ("MIT", ["MIT"]),
        3: (None, []),
    }


def test_forms_are_made_once(docs_of, known):
    """A form that is read in several places is a column, not an expression repeated in each of them."""
    docs = docs_of("Some text.\n" + licences.KNOWN["MIT notice"])
    plan = licences.find_licences(docs, known)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"[^\p{L}\p{N}\n]+") == 1
    texts = plan.split("Join LeftOuter")[1].split("Aggregate")[0]  # the documents, without the known licences
    assert texts.count(r"[^\p{L}\p{N}]+") == 1
