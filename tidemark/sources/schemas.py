"""Declared schemas and the column spellings that drift between years."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Declared types of the raw extracts (fixed layouts).
CATCH_RAW = "YEAR int, ZONE string, GEAR string, GEAR1 string, TYPE string, TONS double"
CATCH_POSTED = "year int, fmp_subarea string, weight_posted double"
WEEKLY_CATCH = "species string, date string, catch double"
BIOMASS_TOTAL = (
    "YEAR int, BIOM double, POP double, BIOMVAR double, POPVAR double, NUMHAULS int, NUMCAUGHT int"
)
BIOMASS_AREA = BIOMASS_TOTAL + ", AREA string"
AREA_DEPTH = "YEAR int, REGULATORY_AREA_NAME string, `Depth.range` string, total_biomass double"
SURVEY_LENGTH = (
    "YEAR int, SPECIES_CODE int, HAULJOIN decimal(38,0), CATCHJOIN decimal(38,0), REGION string, "
    "LENGTH double, FREQUENCY int, SEX int"
)
FISHERY_LENGTH_COMP = "YEAR int, LENGTH int, SEX string, LNUMBERS double"
SIZECOMP_TOTAL = (
    "SURVEY string, YEAR int, SPECIES_CODE int, SUMMARY_AREA int, LENGTH int, MALES double, "
    "FEMALES double, UNSEXED double, TOTAL double"
)
AGECOMP_TOTAL = "SURVEY string, SURVEY_YEAR int, SPECIES_CODE int, AGE int, SEX int, AGEPOP double"
SCENARIO_LONG = "stock string, alt int, year int, metric string, value double"
SCENARIO_WIDE = "stock string, year int, catch double, abc double, ofl double, ssb double, totbiom double"
HARVEST_LIMITS = "Yr int, variable string, value double"
EASTERN_FRACTIONS = "Western_Fraction double, Eastern_Fraction double"
MODEL_INDEX = "Year int, Estimate_metric_tons double, SD_log double, SD_mt double"

# Lower-case spelling -> canonical name (fixed values).
ALIASES = {
    "yr": "year",
    "survey_year": "year",
    "collection_year": "year",
    "fmp_subarea": "zone",
    "zone": "zone",
    "tons": "tons",
    "weight_posted": "tons",
    "biom": "biomass",
    "total_biomass": "biomass",
    "biomass_mt": "biomass",
    "biomvar": "biomass_var",
    "biomass_var": "biomass_var",
    "area": "area",
    "area_name": "area",
    "regulatory_area_name": "area",
    "length": "length",
    "sex": "sex",
}


def canonical(df: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """Lower-case all names and replace known spellings."""
    return df.toDF(*[aliases.get(c.lower(), c.lower()) for c in df.columns])
