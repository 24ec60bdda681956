import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .conftest import DOCUMENTS
from .test_jaccard import brute

REPO = Path(corpus_pipeline.__file__).parent
SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """The small documents with planted cases behind them."""
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    base = docs.where("n_chars BETWEEN 1500 AND 4000 AND lang = 'en'").orderBy("doc_id").limit(4).collect()
    planted = [
        (10_000, None, "en", "p", 0),
        (10_001, "", "en", "p", 0),
        (10_002, "12345 67890 !!", "en", "p", 14),
        (10_003, base[0]["text"], "en", "p", 1),
        (10_004, base[1]["text"].replace(" the ", " that ", 2), "en", "p", 1),
        (10_005, base[2]["text"][:700] + "\n" + items[3] + "\n" + base[3]["text"][700:1400], "en", "p", 1),
        (10_006, base[3]["text"][::-1] + " password = hunter2hunter2 end", "en", "p", 1),
    ]
    rows = docs.select(COLUMNS).unionByName(spark.createDataFrame(planted, DOCUMENTS))
    rows.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), items


def test_stages_keep_clean_documents_and_catch_planted_ones(spark, corpus):
    folder, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = {r["doc_id"]: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "jaccard_join", "decontamination", "secret_scans", "packing"]

    named = stages["language_id"](spark, docs, folder)
    kept = {r["doc_id"]: r for r in named.collect()}
    assert named.columns == COLUMNS
    assert {10_000, 10_001, 10_002}.isdisjoint(kept)
    assert len(kept) > 0.95 * len(given) and all(kept[k] == given[k] for k in kept)

    groups = brute([tuple(r) for r in kept.values()])
    single = stages["jaccard_join"](spark, named, folder)
    left = {r["doc_id"] for r in single.collect()}
    assert left == {int(key) for key, _, component in groups if key == component}
    assert {10_003, 10_004}.isdisjoint(left)

    clean = stages["decontamination"](spark, single, folder)
    held = {k for k in left if any(item in (given[k]["text"] or "") for item in items.values())}
    after = {r["doc_id"] for r in clean.collect()}
    assert 10_005 in held and held.isdisjoint(after) and len(after) > len(left) - 2 * len(held) - 3

    masked = {r["doc_id"]: r for r in stages["secret_scans"](spark, clean, folder).collect()}
    assert set(masked) == after
    assert "hunter2" not in masked[10_006]["text"] and masked[10_006]["text"].endswith("[secret] end")
    assert all(r["n_chars"] == len(r["text"]) for r in masked.values())


def test_run_gives_the_last_stage(spark, corpus):
    folder, _ = corpus
    pieces = corpus_pipeline.run(spark, folder).collect()
    by_doc = {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    for parts in by_doc.values():
        assert sum(length for _, length, _ in parts) == parts[0][2]
        assert sorted(parts)[0][0] == 0
    assert {10_000, 10_003, 10_005}.isdisjoint(by_doc) and 10_006 in by_doc


def test_repeated_rows_and_empty_table(spark, corpus):
    folder, _ = corpus
    row = (1, "some words that repeat in two equal rows of this table", "en", "s", 1)
    twice = spark.createDataFrame([row, row, (2, None, "en", "s", 0), (2, None, "en", "s", 0), (None, "x y", "en", "s", 1)], DOCUMENTS)
    left = corpus_pipeline.duplicates_stage(spark, twice, folder).collect()
    assert sorted(str(r["doc_id"]) for r in left) == ["1", "2", "2", "None"]
    empty = spark.createDataFrame([], DOCUMENTS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).collect() == []


def test_rows_of_one_key_are_judged_one_by_one(spark, corpus):
    folder, items = corpus
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(COLUMNS)
    base = [r["text"] for r in docs.where("n_chars BETWEEN 1500 AND 4000 AND lang = 'en'").orderBy("doc_id").limit(5).collect()]
    near = base[0].replace(" the ", " that ", 2)
    held = base[3][:700] + "\n" + items[3] + "\n" + base[4][700:1400]
    for key in (None, 90_000):
        def rows(*texts, key=key):
            return spark.createDataFrame([(key, text, "en", "p", 1) for text in texts], DOCUMENTS)

        def left(stage, given, key=key):
            return sorted(r["text"] for r in stage(spark, given, folder).where(F.col("doc_id").eqNullSafe(F.lit(key))).collect())

        assert left(corpus_pipeline.language_stage, docs.unionByName(rows(base[0], "12 34", base[1]))) == sorted(base[:2])
        assert left(corpus_pipeline.decontamination_stage, docs.unionByName(rows(base[0], held, base[1]))) == sorted(base[:2])
        single = left(corpus_pipeline.duplicates_stage, rows(base[0], near, base[0], base[1]))
        assert len(single) == 2 and base[1] in single
    named = rows(near).unionByName(spark.createDataFrame([(None, base[0], "en", "p", 1)], DOCUMENTS))
    assert [r["doc_id"] for r in corpus_pipeline.duplicates_stage(spark, named, folder).collect()] == [90_000]


def test_mixed_texts_stay_and_unlearned_ones_go(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(COLUMNS)
    by_lang = {x: " ".join(r["text"] for r in docs.where(F.col("lang") == x).orderBy("doc_id").limit(3).collect()).split() for x in ("en", "fr", "de")}
    rng = random.Random(3)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(80))
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto"
    mixed = " ".join([*by_lang["en"][:40], *by_lang["fr"][:30], *by_lang["de"][:30]])
    added = [(90_000, mixed), (90_001, noise), (90_002, finnish), (90_003, "12 34"), (90_004, "этот текст не выучен")]
    rows = docs.unionByName(spark.createDataFrame([(key, text, None, "p", 1) for key, text in added], DOCUMENTS))
    left = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, rows, folder).collect()}
    assert {key for key, _ in added} & left == {90_000}
    assert len(left) > 0.99 * docs.where("text <> ''").count()


def test_the_language_stage_decides_by_identified_spans(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(COLUMNS)
    identify, seen = corpus_pipeline.language.identify_languages, []

    def of_one_language(*args, **options):  # no word is in a span of another language
        found = identify(*args, **options)
        seen.append(set(found.columns))
        return found.withColumn("explained", F.when(F.col("lang_pred") == "de", F.col("explained")).otherwise(0.0))

    monkeypatch.setattr(corpus_pipeline.language, "identify_languages", of_one_language)
    left = corpus_pipeline.language_stage(spark, docs, SMALL).collect()
    assert seen and {"lang_pred", "spans", "explained"} <= seen[0]
    assert left and sum(r["lang"] == "de" for r in left) > 0.9 * len(left)


def test_languages_are_learned_from_documents_without_a_key(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(COLUMNS).where("text <> ''").withColumn("doc_id", F.lit(None).cast("long"))
    assert corpus_pipeline.language_stage(spark, docs, SMALL).count() > 0.99 * docs.count()


def test_other_columns_stay_whatever_their_names(spark, corpus, tmp_path):
    folder, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60 OR doc_id >= 10000")
    names = {"__row": "a", "row": "b", "row_file": "c", "row_place": "d", "key": "e", "label": "f"}
    extra = docs.withColumns({name: F.concat(F.lit(value), F.col("doc_id")) for name, value in names.items()})
    extra.write.parquet(str(tmp_path / "docs"))
    for given in (extra, spark.read.parquet(str(tmp_path / "docs")), spark.createDataFrame(extra.collect(), extra.schema)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, given, folder)
            assert found.columns == given.columns
            rows = found.collect()
            assert rows and all(r[column] == f"{value}{r['doc_id']}" for r in rows for column, value in names.items()), name


@pytest.mark.parametrize("pipeline_file", ["corpus_pipeline.py", "none"])
def test_the_rest_works_without_these_folders(tmp_path, pipeline_file):
    ignore = shutil.ignore_patterns("llm", pipeline_file, ".git", "__pycache__", "spark-warehouse")
    shutil.copytree(REPO, tmp_path / "repo", ignore=ignore)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    count, any_left = done.stdout.split()
    assert int(count) > 100 and any_left == "False", done.stderr


def test_the_rest_works_without_a_library_of_these_folders():
    code = (
        "import sys; sys.modules['public_tokenizers'] = None\n"
        "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q))"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    count, any_left = done.stdout.split()
    assert int(count) > 100 and any_left == "False", done.stderr
