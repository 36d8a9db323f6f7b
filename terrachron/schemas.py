"""Schemas of the canonical inputs."""

CAMPAIGN = "region string, year int, start_date date, db string"
PROVINCE = "province string, number int, region string"
PARCEL_VERSION = (
    "dn_oid long, dn_geom binary, dn_initialdate date, dn_enddate date, dn_initialdate_1 date, dn_enddate_1 date, "
    "cap_prevalente string, uso_sigpac string, incidencias string, provincia int, municipio int, agregado int, "
    "zona int, poligono int, parcela int, recinto int"
)
DECLARATION_LINE = (
    "dn_pk long, dn_oid long, dn_geom binary, dn_initialdate date, dn_enddate date, parc_producto double, "
    "provincia int, municipio int, agregado int, zona int, poligono int, parcela int, recinto int"
)
PIXEL = "tile string, orbit int, ts timestamp, x double, y double, " + ", ".join(f"b{k:02d} double" for k in range(1, 13)) + ", b8a double, scl int"
ITEM = "item_id string, tile string, orbit int, ts timestamp"
SERIES = "id string, ts date, ndvi double, ar double, as1 double"
THRESHOLDS = "tam double, days double, productivity double"
