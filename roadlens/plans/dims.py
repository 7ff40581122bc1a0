"""The two fixed dimensions. Both are a handful of rows that never grow with the data."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Municipality codes and names of the metropolitan region.
CITIES = {
    2600054: "Abreu e Lima",
    2601052: "Araçoiaba",
    2602902: "Cabo de Santo Agostinho",
    2603454: "Camaragibe",
    2606804: "Igarassu",
    2607604: "Ilha de Itamaracá",
    2607208: "Ipojuca",
    2607752: "Itapissuma",
    2607901: "Jaboatão dos Guararapes",
    2609402: "Moreno",
    2609600: "Olinda",
    2610707: "Paulista",
    2611606: "Recife",
    2613701: "São Lourenço da Mata",
}


class Mode(NamedTuple):
    ordinal: int
    key: str
    label: str
    codes: str
    prefix: str


#: Modes of transport by prefix of the cause of death. Codes V90 to V98 belong to none.
MODES = tuple(
    Mode(i, *x)
    for i, x in enumerate(
        [
            ("pedestrian", "Pedestre", "V01-V09", "V0"),
            ("cyclist", "Ciclista", "V10-V19", "V1"),
            ("motorcyclist", "Motociclista", "V20-V29", "V2"),
            ("tricycle", "Ocupante de triciclo", "V30-V39", "V3"),
            ("car", "Ocupante de automóvel", "V40-V49", "V4"),
            ("pickup", "Ocupante de caminhonete", "V50-V59", "V5"),
            ("heavy_vehicle", "Ocupante de veículo pesado", "V60-V69", "V6"),
            ("bus", "Ocupante de ônibus", "V70-V79", "V7"),
            ("other", "Outros modos", "V80-V89", "V8"),
            ("unspecified", "Não especificado", "V99", "V99"),
        ]
    )
)
PREFIXES = {m.key: m.prefix for m in MODES}
CYCLIST_PREFIX = PREFIXES["cyclist"]


def city_name(code: Column) -> Column:
    """The name of a municipality, null for one that isn't in the dictionary: a map in the plan, no join."""
    pairs = [x for c, n in CITIES.items() for x in (F.lit(c), F.lit(n))]
    return F.try_element_at(F.create_map(*pairs), code)


def cities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CITIES.items()), "city_code int, city_name string")


def modes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(m) for m in MODES], "ordinal int, key string, mode string, cid10_codes string, prefix string")
