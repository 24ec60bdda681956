import math
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope import presets
from tabscope.functions.numbers import (
    age_from_year,
    assumption_label,
    band_label,
    coerce_numeric,
    decision_label,
    min_max_scale,
    rate_per,
    round_half_even,
    strict_numeric,
)
from tabscope.functions.recode import collapse_levels, recode
from tabscope.functions.stats import chi2_sf, cramers_v
from tabscope.presets import TRAILING_ARTICLES
from tabscope.functions.text import key_digest, normalize_key, zero_pad_code

NAMES = {
    "Hospitalet de Llobregat, l'": "l hospitalet de llobregat",
    "L'Hospitalet de Llobregat": "l hospitalet de llobregat",
    "Franqueses del Vallès, les": "les franqueses del valles",
    "Prat de Llobregat, EL": "el prat de llobregat",
    "  Vila-seca ": "vila seca",
    "L’Hospitalet": "lhospitalet",
    "Col·legi": "collegi",
    "Bisbal, La": "la bisbal",
    "Sant Adrià de Besòs": "sant adria de besos",
    "Espluga, l' ": "l espluga",
    "Straße Nº 5": "strae no 5",
    "a…b": "a b",
    "ﬁn ½": "fin 12",
    "Café": "cafe",
    "": "",
    "東京": "",
}


def spelled(text: str) -> str:
    """The rule of the key, said again with the standard library."""
    text = text.strip()
    found = re.match(r"^(.*),\s*(l'|el|la|els|les)$", text, flags=re.IGNORECASE)
    text = f"{found[2]} {found[1]}" if found else text
    text = text.lower().replace("l' ", "l ").replace("l'", "l ")
    text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    return " ".join(re.findall("[a-z0-9]+", text))


def test_normalize_key(column):
    def key(name):
        return normalize_key(name, TRAILING_ARTICLES)

    got = column(key, [*NAMES, None])
    assert dict(zip(NAMES, got)) == NAMES
    assert got[-1] is None
    others = [
        "ÀÈÌ òù ç ñ", "Ångström—Ÿ", "tab\tand\nline", "100 % d'aigua", "(les)", "x, les, els", "Ĳssel", "①②", "5 ㎏", "⑩ coses",
        "a\0b", "㈱ ㌔ ℡ ﷺ", "ﬃ ǆ", "l'Escala", "Escala, l'",
    ]
    assert column(key, others) == [spelled(name) for name in others]
    assert column(normalize_key, ["Escala, l'", "A, la"]) == ["escala l", "a la"]


def test_zero_pad_code(column):
    codes = ["8001", "08001", "123456", "7", "-12", "+5", "", None]
    assert column(zero_pad_code, codes) == [None if c is None else c.zfill(5) for c in codes]


def test_key_digest_keeps_short_texts(column):
    texts = ["a", "b" * 64, "c" * 65, "c" * 65, None]
    got = column(key_digest, texts)
    assert got[:2] == texts[:2] and got[2] == got[3] and len(got[2]) == 65 and got[4] is None


def test_numbers_from_text(column):
    texts = ["12 ", "1e3", "1d", "nan", "abc", "", "-.5", "+7.", None, "1 2"]
    assert column(coerce_numeric, texts) == [12.0, 1000.0, None, None, None, None, -0.5, 7.0, None, None]
    assert column(strict_numeric, ["12", " 3.5", None]) == [12.0, 3.5, None]
    with pytest.raises(Exception, match="not a number: abc"):
        column(strict_numeric, ["abc"])


def test_round_half_even_equals_numpy(column):
    rng = np.random.default_rng(0)
    values = [0.125, 0.575, 2.675, -0.005, 1e9 + 0.005, *rng.normal(0, 100, 500), *(np.arange(200) / 200)]
    got = column(round_half_even, [float(v) for v in values], "double")
    assert got == [float(np.round(v, 2)) for v in np.array(values)]


def test_small_helpers(column):
    assert column(lambda c: age_from_year(c, 2026), [1990.0, None], "double") == [36.0, None]
    assert column(lambda c: rate_per(F.lit(3), c), [0.0, 6.0, None], "double") == [None, 5000.0, None]
    bands = column(band_label, [0.0, 0.1, 0.3, 0.5, 0.9, None], "double")
    assert bands == ["very weak", "weak", "moderate", "strong", "strong", None]
    assert column(decision_label, [0.049, 0.05, None], "double") == ["reject H0", "do not reject H0", None]
    assert column(assumption_label, [0, 2], "int") == ["met", "interpret with caution"]


def test_min_max_scale(column):
    scale = lambda c: min_max_scale(c, F.lit(2.0), F.lit(4.0), 10, 20)
    assert column(scale, [2.0, 3.0, 4.0, None], "double") == [10.0, 15.0, 20.0, None]
    flat = lambda c: min_max_scale(c, F.lit(3.0), F.lit(3.0))
    assert column(flat, [3.0, None], "double") == [0.5, None]


def test_recode_first_match_wins(column):
    texts = ["Bibliotecas Públicas", "otras instituciones de enseñanza superior", "Bibliotecas especializadas de x", None, "?"]
    assert column(lambda c: recode(c, presets.TYPE_RULES, presets.TYPE_DEFAULT), texts) == [
        "Bibliotecas publicas", "Bibliotecas universitarias", "Bibliotecas especializadas", "Otras tipologias",
        "Otras tipologias",
    ]
    managers = ["Gestión compartida - Administración Local", "Privada con fines", "x Poder Judicial", "Universitaria - Privada"]
    assert column(lambda c: recode(c, presets.MANAGER_RULES, presets.MANAGER_DEFAULT), managers) == [
        "Gestion compartida", "Privada", "Poder judicial", "Universitaria privada",
    ]
    assert column(lambda c: collapse_levels(c, ["a"], "rest"), ["a", "b", None]) == ["a", "rest", "rest"]


def test_chi2_sf(spark):
    # Upper 5 % points of the distribution, and a far tail.
    points = [(3.841458820694124, 1), (5.991464547107979, 2), (7.814727903251179, 3), (11.070497693516351, 5),
              (124.3421134, 100), (1074.679449, 1000), (5167.3954, 5001)]
    rows = [*points, (117.370, 2), (0.0, 4), (9.0, 0), (None, 2), (10.828, 1), (40.0, 1)]
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "i int, x double, d int").orderBy("i")
    got = [row[0] for row in df.select(chi2_sf("x", "d")).collect()]
    assert got[:6] == pytest.approx([0.05] * 6, rel=1e-6)
    assert 0.045 < got[6] < 0.055
    assert got[7] == pytest.approx(math.exp(-117.370 / 2), rel=1e-12)
    assert f"{got[7]:.2e}" == "3.26e-26"
    assert got[8:11] == [1.0, 1.0, None]
    assert got[11:] == pytest.approx([math.erfc(math.sqrt(x / 2)) for x in (10.828, 40.0)], rel=1e-12)


def test_cramers_v(spark):
    row = spark.range(1).select(
        cramers_v(F.lit(117.370), F.lit(519), F.lit(3), F.lit(2)).alias("v"),
        cramers_v(F.lit(0.0), F.lit(0), F.lit(3), F.lit(2)).alias("none"),
        cramers_v(F.lit(1.0), F.lit(9), F.lit(1), F.lit(2)).alias("flat"),
    ).first()
    assert round(row["v"], 3) == 0.476 and row["none"] == 0.0 and row["flat"] == 0.0
