"""Declared schemas: columns, keys, parents and geometry kind of the domain tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from citylake.functions.geometry import GEOM_TYPE, LINE, POINT, POLYGON


@dataclass(frozen=True)
class TableSpec:
    columns: str
    keys: tuple[str, ...] = ("id",)
    parents: dict[str, str] = field(default_factory=dict)
    geom: str | None = None
    required: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        geom = f", geom {GEOM_TYPE}" if self.geom else ""
        return T.StructType.fromDDL(self.columns + geom)


TABLES = {
    "province": TableSpec("id long, name string, population long, density double, area_km2 double", geom=POLYGON, required=("id", "name")),
    "city": TableSpec("id long, province_id long, name string, population long, density double, area_km2 double", parents={"province_id": "province"}, geom=POLYGON, required=("id", "name")),
    "district": TableSpec("id string, city_id long, name string, population long, density double, area_km2 double", parents={"city_id": "city"}, geom=POLYGON, required=("id",)),
    "neighborhood": TableSpec("id string, district_id string, name string, population long, density double, area_km2 double", parents={"district_id": "district"}, geom=POLYGON, required=("id",)),
    "consumption_capita": TableSpec("id long, city_id long, year int, l_per_day double, m3_yr double", ("city_id", "year"), {"city_id": "city"}),
    "users_location": TableSpec("id long, neighborhood_id string, users_total long, served long", parents={"neighborhood_id": "neighborhood"}),
    "metered_residential": TableSpec("id long, users_location_id long, installed long, functional long, collected long, tariff double, consumption double, recovery double", parents={"users_location_id": "users_location"}),
    "fresh_water": TableSpec("id long, name string, quantity_mm3 double", geom=POLYGON),
    "well": TableSpec("id long, source_id long, flow_m3_s double, hours double, kwh_h double, co2_factor double, co2_day double, opex_m3 double, labor double, energy double, chemicals double, tax double, current_mm3_yr double, co2_cost double, drought_damage double, is_active boolean", parents={"source_id": "fresh_water"}, geom=POINT),
    "imported_water": TableSpec("id long, m3_d double, price double, is_active boolean"),
    "water_treatment": TableSpec("id long, year int, efficiency double, samples_ok long, samples_taken long, energy double, acceptance double"),
    "pipe": TableSpec("id long, length_km double, diameter_mm double, diameter_in double, origin_id long, destination_id long", parents={"destination_id": "users_location"}, geom=LINE),
    "coverage": TableSpec("id long, city_id long, year int, buffer_m double, area_km2 double, covered long, total long, pct double", parents={"city_id": "city"}),
    "loss": TableSpec("id long, year int, type string, category string, m3 double, unavoidable_pct double, ili double, last_updated timestamp"),
    "opex": TableSpec("id long, year int, unit double, total double"),
    "drought_area": TableSpec("id long, province_id long, year int, level int, area_km2 double", parents={"province_id": "province"}),
    "electricity_cost": TableSpec("id long, province_id long, year int, eur_kwh double", parents={"province_id": "province"}),
    "housing_supply_demand": TableSpec("id long, city_id long, year int, supply long, demand long", ("city_id", "year"), {"city_id": "city"}),
    "housing_project": TableSpec("id long, neighborhood_id string, year int, year_completion int, units long", parents={"neighborhood_id": "neighborhood"}),
    "central_bank_policy": TableSpec("id long, province_id long, year int, rate double, ltv double, lti double", parents={"province_id": "province"}),
    "credit_supply": TableSpec("id long, province_id long, year int, rate double, approval double, down_payment double", parents={"province_id": "province"}),
    "mortgage": TableSpec("id long, property_id long, loan double, rate double, term_years int, monthly double", parents={"property_id": "property"}),
    "rental": TableSpec("id long, property_id long, monthly double, annual double, price_to_rent double", parents={"property_id": "property"}),
    "house_price_index": TableSpec("id long, neighborhood_id string, year int, value double", parents={"neighborhood_id": "neighborhood"}),
    "affordability": TableSpec("id long, neighborhood_id string, year int, income double, expenditure double, rent double, mortgage double, price double, disposable double, index double, stress string", parents={"neighborhood_id": "neighborhood"}),
    "zoning_area": TableSpec("id long, neighborhood_id string, type string, area double, benchmark double", parents={"neighborhood_id": "neighborhood"}),
    "street": TableSpec("id long, width double", geom=LINE),
    "park": TableSpec("id long, area double", geom=POLYGON),
    "building": TableSpec("id long, neighborhood_id string, height double, footprint double, units long, vacant boolean, vacancy_rate double", parents={"neighborhood_id": "neighborhood"}, geom=POLYGON),
    "property": TableSpec("id long, building_id long, living_area double, listing double, sale double, per_sqm double", parents={"building_id": "building"}, geom=POINT),
    "station": TableSpec("id long, name string, elevation double, is_active boolean", geom=POINT),
    "measurement": TableSpec("station_id long, date timestamp, precipitation double, wind double, temperature double, radiation double, humidity double, vapor_pressure double", ("station_id", "date"), {"station_id": "station"}),
    "raster_meta": TableSpec("id long, kind string, name string, date date, created_at timestamp, resolution double, method string, product_path string"),
    "cells": TableSpec("raster_id long, date date, band string, col long, row long, x double, y double, value double", ("raster_id", "date", "band", "col", "row"), {"raster_id": "raster_meta"}),
    "land_cover_class": TableSpec("id long, class_name string"),
    "land_cover": TableSpec("id long, province_id long, year int, class_id long, percentage double", parents={"province_id": "province", "class_id": "land_cover_class"}),
    "nbs_polygon": TableSpec("id long, name string, area double", geom=POLYGON),
    "nbs_point": TableSpec("id long, name string", geom=POINT),
}
