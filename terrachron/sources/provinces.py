"""Provinces, their numbers and the region of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PROVINCE

#: Number, province, region.
TABLE = """
1 Alava PAIS-VASCO
2 Albacete CASTILLA-LA-MANCHA
3 Alicante VALENCIANA
4 Almeria ANDALUCÍA
5 Avila CASTILLA-Y-LEÓN
6 Badajoz EXTREMADURA
7 Baleares BALEARES
8 Barcelona CATALUÑA
9 Burgos CASTILLA-Y-LEÓN
10 Caceres EXTREMADURA
11 Cadiz ANDALUCÍA
12 Castellon VALENCIANA
13 CiudadReal CASTILLA-LA-MANCHA
14 Cordoba ANDALUCÍA
15 Coruña GALICIA
16 Cuenca CASTILLA-LA-MANCHA
17 Girona CATALUÑA
18 Granada ANDALUCÍA
19 Guadalajara CASTILLA-LA-MANCHA
20 Guipuzcoa PAIS-VASCO
21 Huelva ANDALUCÍA
22 Huesca ARAGÓN
23 Jaen ANDALUCÍA
24 Leon CASTILLA-Y-LEÓN
25 Lleida CATALUÑA
26 LaRioja LA-RIOJA
27 Lugo GALICIA
28 Madrid MADRID
29 Malaga ANDALUCÍA
30 Murcia MURCIA
31 Navarra NAVARRA
32 Ourense GALICIA
33 Asturias ASTURIAS
34 Palencia CASTILLA-Y-LEÓN
35 LasPalmas CANARIAS
36 Pontevedra GALICIA
37 Salamanca CASTILLA-Y-LEÓN
38 Tenerife CANARIAS
39 Cantabria CANTABRIA
40 Segovia CASTILLA-Y-LEÓN
41 Sevilla ANDALUCÍA
42 Soria CASTILLA-Y-LEÓN
43 Tarragona CATALUÑA
44 Teruel ARAGÓN
45 Toledo CASTILLA-LA-MANCHA
46 Valencia VALENCIANA
47 Valladolid CASTILLA-Y-LEÓN
48 Vizcaya PAIS-VASCO
49 Zamora CASTILLA-Y-LEÓN
50 Zaragoza ARAGÓN
"""


def provinces(spark: SparkSession) -> DataFrame:
    rows = [line.split() for line in TABLE.strip().splitlines()]
    return spark.createDataFrame([(name, int(number), region) for number, name, region in rows], PROVINCE)


def with_campaigns(campaigns: DataFrame) -> DataFrame:
    """province, number, region, year, start_date, db: the 50 provinces with their region's campaigns."""
    return campaigns.join(F.broadcast(provinces(campaigns.sparkSession)), "region").select("province", "number", "region", "year", "start_date", "db")
