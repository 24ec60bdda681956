"""Ready-made settings for the library-directory analysis: a directory of libraries enriched by town figures.

The operators know nothing of this domain; everything particular to it is listed here. The texts are fixed values:
they must equal those of the source data, or the published category names, for the results to agree.
"""

from __future__ import annotations

from tabscope.functions.recode import RecodeRule
from tabscope.operators.quality import (
    BinaryRule,
    DerivedFlagRule,
    DomainRule,
    DuplicateRule,
    ForbiddenColumnRule,
    NoteRule,
    NotNullRule,
    RangeRule,
)
from tabscope.plans.flows import CleanSpec, IntegrateSpec, ModelSpec

# Columns of the town table, in file order.
TOWN_SCHEMA = (
    "municipio_idescat string, poblacion_municipio long, superficie_km2 double, densidad_hab_km2 double, "
    "rango_poblacion_cat int, anio_poblacion int, fuente_poblacion string"
)

# Recoding rules in order of precedence, and the label when none applies.
TYPE_RULES = (
    RecodeRule("prefix", "Bibliotecas Públicas", "Bibliotecas publicas"),
    RecodeRule("contains", "instituciones de enseñanza superior", "Bibliotecas universitarias"),
    RecodeRule("prefix", "Bibliotecas especializadas", "Bibliotecas especializadas"),
    RecodeRule("prefix", "Bibliotecas para grupos específicos", "Bibliotecas para grupos especificos"),
)
TYPE_DEFAULT = "Otras tipologias"
OWNER_RULES = (
    RecodeRule("contains", "Administración Local", "Administracion local"),
    RecodeRule("contains", "Administración Autonómica", "Administracion autonomica"),
    RecodeRule("contains", "Administración General del Estado", "Administracion general del estado"),
    RecodeRule("contains", "Universitaria - Pública", "Universitaria publica"),
    RecodeRule("contains", "Universitaria - Privada", "Universitaria privada"),
    RecodeRule("prefix", "Privada", "Privada"),
    RecodeRule("contains", "Poder Judicial", "Poder judicial"),
)
OWNER_DEFAULT = "Otras titularidades"
MANAGER_RULES = (RecodeRule("contains", "Gestión compartida", "Gestion compartida"), *OWNER_RULES)
MANAGER_DEFAULT = "Otras gestiones"
CONTRAST_KEEP = ("Bibliotecas publicas", "Bibliotecas universitarias")
CONTRAST_OTHER = "Bibliotecas especializadas, especificas y otras"

# Column names of the published tables, in their order.
SUFFIX = "_imputada"
TARGET = "tiene_catalogo"
NUMERIC = ("antiguedad_biblioteca", "bibliotecas_municipio", "poblacion_municipio", "densidad_hab_km2")
IMPUTED = ("antiguedad_biblioteca", "poblacion_municipio", "densidad_hab_km2")
TOWN_VALUES = ("poblacion_municipio", "densidad_hab_km2")
PLAIN_FLAGS = ("tiene_web", "anio_fundacion_missing", "tiene_poblacion_externa")
FLAGS = (*PLAIN_FLAGS, *(f"{name}{SUFFIX}" for name in IMPUTED))
RECODES = {
    "tipologia_simplificada": ("tipologia", TYPE_RULES, TYPE_DEFAULT),
    "titularidad_simplificada": ("titularidad", OWNER_RULES, OWNER_DEFAULT),
    "gestion_simplificada": ("gestion", MANAGER_RULES, MANAGER_DEFAULT),
}
MODEL_COLUMNS = (
    TARGET, "tiene_web", "tipologia", "titularidad", "gestion", "antiguedad_biblioteca", "anio_fundacion_missing",
    "bibliotecas_municipio", "poblacion_municipio", "densidad_hab_km2", "tiene_poblacion_externa",
)

# Articles that may trail a place name after a comma.
TRAILING_ARTICLES = ("l'", "el", "la", "els", "les")

INTEGRATE = IntegrateSpec(
    key="municipio",
    dim_key="municipio_idescat",
    counted="nombre",
    count_name="bibliotecas_municipio",
    match_flag="tiene_poblacion_externa",
    match_source="poblacion_municipio",
    articles=TRAILING_ARTICLES,
    pad={"codigo_postal": 5},
    present_flags={"tiene_web": "pagina_web", TARGET: "acceso_catalogo"},
    missing_flags={"anio_fundacion_missing": "anio_fundacion"},
    year=("anio_fundacion", "anio_fundacion_num", "antiguedad_biblioteca"),
    reference_year=2026,
    rates={"bibliotecas_por_10000_habitantes": ("bibliotecas_municipio", "poblacion_municipio")},
)


def _labels(rules: tuple[RecodeRule, ...], default: str) -> tuple[str, ...]:
    return (*(rule.label for rule in rules), default)


SOURCE_RULES = (
    DuplicateRule(),
    DuplicateRule(("url_ficha",)),
    DuplicateRule(("nombre",), action="keep, a name alone does not identify a library"),
    DerivedFlagRule("tiene_web", "pagina_web"),
    DerivedFlagRule(TARGET, "acceso_catalogo"),
    DerivedFlagRule("anio_fundacion_missing", "anio_fundacion", when_present=False),
)
TYPED_RULES = (
    *(BinaryRule(name) for name in (TARGET, *FLAGS)),
    RangeRule("antiguedad_biblioteca", 0, strict=True),
    RangeRule("bibliotecas_municipio", 1),
    RangeRule("poblacion_municipio", 0, strict=True),
    RangeRule("densidad_hab_km2", 0, strict=True),
    *(DomainRule(name, _labels(rules, default)) for name, (_, rules, default) in RECODES.items()),
    *(NotNullRule(name) for name in RECODES),
    NoteRule("redundancy", "original and recoded categories", "both kept", "model the recoded ones", "for tracing"),
    ForbiddenColumnRule("acceso_catalogo"),
    NoteRule("leakage", "use of tiene_web", "included", "read with care", "a proxy of digital presence"),
)


def clean_spec(key: str = "url_ficha") -> CleanSpec:
    """Settings of the cleaning stage; ``key`` identifies a row through to the models."""
    return CleanSpec(
        columns=(key, *MODEL_COLUMNS),
        impute=IMPUTED,
        distinct_medians=TOWN_VALUES,
        binary=(TARGET, *FLAGS),
        numeric=NUMERIC,
        recodes=RECODES,
        rules=TYPED_RULES,
        source_rules=SOURCE_RULES,
        suffix=SUFFIX,
    )


def model_spec(key: str = "url_ficha") -> ModelSpec:
    return ModelSpec(key=key, target=TARGET, numeric=NUMERIC, binary=FLAGS, categorical=tuple(RECODES))
