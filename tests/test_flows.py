"""The library-directory analysis from raw CSV texts to every report."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tabscope import presets
from tabscope.plans.flows import association_flow, cleaning_flow, clustering_flow, integrate_flow, supervised_flow
from workload import analysis

TOWNS = [
    ("Barcelona", 1713247, 101.4, 16904.3, 1), ("Hospitalet de Llobregat, l'", 292161, 12.4, 23561.4, 2),
    ("Terrassa", 232676, 70.2, 3316.4, 3), ("Prat de Llobregat, el", 66251, 31.4, 2109.2, 20),
]
SPELLINGS = ["Barcelona", "BARCELONA ", "L'Hospitalet de Llobregat", "Terrassa", "El Prat de Llobregat", "Vic"]
TYPES = ["Bibliotecas Públicas", "Bibliotecas de instituciones de enseñanza superior", "Bibliotecas especializadas", "Otra"]
OWNERS = ["Administración Local", "Privada", "Universitaria - Pública"]


@pytest.fixture(scope="module")
def integrated(spark):
    rng = random.Random(4)
    rows = []
    for i in range(160):
        kind = rng.choice(TYPES)
        has_catalogue = rng.random() < (0.9 if kind.startswith("Bibliotecas P") else 0.5)
        rows.append(
            (
                f"Biblioteca {i % 150}", rng.choice(SPELLINGS), str(rng.choice([8001, 8002, 43003])),
                rng.choice(["http://w", None]), "http://c" if has_catalogue else None,
                rng.choice(["1950", "1999", "2004", None, "s.f."]), kind, rng.choice(OWNERS),
                rng.choice([*OWNERS, "Gestión compartida"]), f"http://ficha/{i}",
            )
        )
    names = "nombre, municipio, codigo_postal, pagina_web, acceso_catalogo, anio_fundacion, tipologia, titularidad, gestion, url_ficha"
    fact = spark.createDataFrame(rows, ", ".join(f"{name} string" for name in names.split(", ")))
    towns = spark.createDataFrame([(*town, 2025, "Idescat, Censo") for town in TOWNS], presets.TOWN_SCHEMA)
    return integrate_flow(fact, towns, presets.INTEGRATE).cache()


@pytest.fixture(scope="module")
def cleaned(integrated):
    return cleaning_flow(integrated, presets.clean_spec())


def test_integration(integrated):
    rows = integrated.collect()
    assert len(rows) == 160
    for row in rows:
        assert len(row["codigo_postal"]) == 5
        assert row["tiene_poblacion_externa"] == (row["municipio"] != "Vic")
        assert row["tiene_web"] == (row["pagina_web"] is not None)
        if row["anio_fundacion"] in (None, "s.f."):
            assert row["antiguedad_biblioteca"] is None
        else:
            assert row["antiguedad_biblioteca"] == 2026 - int(row["anio_fundacion"])
    towns = {row["municipio_idescat"]: row for row in rows}
    barcelona = towns["Barcelona"]
    n = sum(row["municipio"].strip().lower() == "barcelona" for row in rows)
    assert barcelona["bibliotecas_municipio"] == n
    assert barcelona["bibliotecas_por_10000_habitantes"] == pytest.approx(n / 1713247 * 10000)


def test_cleaning(integrated, cleaned):
    table = cleaned.table
    assert len(table.columns) == 18
    assert table.select([F.count_if(F.col(c).isNull()) for c in presets.NUMERIC]).first()[0] == 0
    towns = {row[0] for row in integrated.select("poblacion_municipio").dropna().distinct().collect()}
    ordered = sorted(towns)
    middle = (ordered[(len(ordered) - 1) // 2] + ordered[len(ordered) // 2]) / 2
    assert cleaned.medians["poblacion_municipio"] == middle
    report = cleaned.report.collect()
    assert len(report) == 26
    by_check = {row["check"]: row for row in report}
    assert by_check["duplicates by nombre"]["result"] == "10"
    assert by_check["acceso_catalogo in the table"]["result"] == "not included"
    assert by_check["other values of tiene_catalogo"]["result"] == "0"
    assert cleaned.levels.where("variable = 'tiene_catalogo'").count() == 2
    assert by_check["unexpected levels of gestion_simplificada"]["result"] == "0"
    assert {row["variable"] for row in cleaned.outliers.collect()} == set(presets.NUMERIC)
    counts = cleaned.distributions["histograms"].groupBy("variable").agg(F.sum("n").alias("n")).collect()
    observed = dict(map(tuple, cleaned.outliers.select("variable", "n").collect()))
    assert {row["variable"]: row["n"] for row in counts} == observed


def test_supervised(cleaned):
    out = supervised_flow(cleaned.table, presets.model_spec())
    metrics = dict(map(tuple, out["metrics"].collect()))
    assert set(metrics) == {"accuracy", "precision_macro", "recall_macro", "f1_macro", "roc_auc"}
    assert 0.4 < metrics["roc_auc"] <= 1
    split = {row["split"]: row["n_rows"] for row in out["split"].collect()}
    assert split == {"train": 112, "test": 48}
    assert sum(row["predicted_0"] + row["predicted_1"] for row in out["confusion"].collect()) == 48
    names = {row["variable"] for row in out["coefficients"].collect()}
    assert "num__poblacion_municipio" in names and "cat__tipologia_simplificada_Bibliotecas especializadas" not in names


def test_clustering(cleaned):
    out = clustering_flow(cleaned.table, presets.model_spec(), 2, 3, n_init=2, flags=["tiene_web"])
    assert [row["k"] for row in out["k_scores"].orderBy("k").collect()] == [2, 3]
    profile = out["profile"].collect()
    assert sum(row["n_rows"] for row in profile) == 160
    assert {"pct_tiene_catalogo", "pct_tiene_web", "mean_densidad_hab_km2", "gestion_simplificada_mode"} <= set(profile[0].asDict())
    assert out["assignments"].count() == 160 and out["pca"].count() == 160
    assert out["features"].where("feature like 'cat__tipologia%'").count() == 4


def test_association(cleaned):
    out = association_flow(
        cleaned.table, "tipologia_simplificada", presets.TARGET, presets.CONTRAST_KEEP, presets.CONTRAST_OTHER, "tipologia_contraste"
    )
    assert out["table_collapsed"].count() == 3 and out["table_original"].count() == 4
    assert out["result_collapsed"].first()["dof"] == 2
    assert out["comments"].count() == 6
    total = out["percent_collapsed"].agg(F.sum("n_total")).first()[0]
    assert total == 160


def test_registered_flows_compute_anew(monkeypatch):
    calls = []
    for name in ("supervised_flow", "clustering_flow", "kmeans_sweep"):
        result = SimpleNamespace(scores=None)
        monkeypatch.setattr(analysis, name, lambda *args, name=name, result=result, **settings: calls.append(name) or result)
    for name in ("_labelled_only", "_vectors", "_cluster_spec", "stage", "_first_centres", "rounded"):
        monkeypatch.setattr(analysis, name, lambda *args: None)
    for flow in (analysis._supervised, analysis._clustering, analysis._sweep):
        flow("one session", "one path")
        flow("one session", "one path")
    assert calls == ["supervised_flow"] * 2 + ["clustering_flow"] * 2 + ["kmeans_sweep"] * 2
