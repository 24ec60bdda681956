import re

from tabscope.llm.licenses import LEAST_DICE, TEMPLATES, scan_licenses, template_bigrams

TEXTS = [
    "Intro.\nLicensed under the Apache License, version 2.0\nMore.", "RELEASED  UNDER THE MIT LICENSE", None, "", "license",
    "This work is licensed under the GNU General Public License version 3 or later", "licensed under CC BY-NC-4.0!",
    "Released\nunder\nthe MIT\nLicense.", "the apache license " * 30, "Released under the MIT License.\n" * 3, "x\n" * 10_000,
]


def brute(key, text, least):
    lines = (text or "").split("\n")
    for segment, part in [*enumerate(lines), *([(-1, text)] if len(lines) > 1 else [])]:
        own = set(template_bigrams(part or ""))
        for name, notice in TEMPLATES.items():
            grams = set(template_bigrams(notice))
            dice = round(2 * len(own & grams) / (len(own) + len(grams)), 6) if own else 0
            if dice >= least:
                yield key, segment, name, len(own), len(own & grams), dice


def test_brute_force_at_any_threshold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [*enumerate(TEXTS), (1, TEXTS[1]), *((1000 + r["doc_id"], r["text"]) for r in docs.collect())]
    df = spark.createDataFrame([(*row, "s", 1) for row in rows], "doc_id long, text string, key string, size int")
    for least in (0.3, LEAST_DICE, 1.0):
        got = sorted(tuple(r) for r in scan_licenses(df, least_dice=least).collect())
        assert got == sorted(found for row in rows for found in brute(*row, least))


def test_no_python_and_empty(spark, no_documents):
    found = scan_licenses(no_documents)
    assert found.collect() == []
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Cartesian|NestedLoop", plan)
