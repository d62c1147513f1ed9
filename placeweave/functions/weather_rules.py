"""Weather rules shared by planning (forecast) and scoring (observation).

Every function reads the columns of a weather row: ``precip_mm``, ``rain_prob``, ``temp_c``,
``wind_kmh``, ``code``, ``period_h`` (optionally behind a prefix)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hazard labels and thresholds.
STORM, HEAVY_RAIN, ROUGH_SEA = "bao", "mua_lon", "song_lon"
HAZARD_LABEL = {"bao": "bão/dông", "mua_lon": "mưa lớn", "song_lon": "biển động"}
RAIN_MM_PER_HOUR = 0.5
HEAVY_RAIN_MM_PER_HOUR = 7.5
RAIN_MM_PER_DAY = 5.0
HEAVY_RAIN_MM_PER_DAY = 50.0
STORM_WIND_KMH = 50.0
ROUGH_SEA_WIND_KMH = 40.0
THUNDERSTORM_CODES = (95, 96, 99)
HEAVY_RAIN_CODES = (65, 82)
SENSITIVITY_DEFAULT = {"rain": 0.5, "heat": 0.5, "wind": 0.2}
TIER_HOURLY, TIER_DAILY, TIER_CLIMATE, TIER_NONE = "hourly", "daily", "climate", "none"


def _daily(p: str) -> Column:
    return F.col(p + "period_h") >= 24


def tier(lead_days: Column) -> Column:
    """How detailed the weather can be this many days ahead."""
    return (F.when(lead_days < 0, TIER_NONE).when(lead_days <= 3, TIER_HOURLY)
            .when(lead_days <= 10, TIER_DAILY).otherwise(TIER_CLIMATE))


def is_raining(p: str = "") -> Column:
    threshold = F.when(_daily(p), RAIN_MM_PER_DAY).otherwise(RAIN_MM_PER_HOUR * F.col(p + "period_h"))
    return F.col(p + "precip_mm") >= threshold


def is_storm(p: str = "") -> Column:
    return (F.col(p + "wind_kmh") >= STORM_WIND_KMH) | F.coalesce(
        F.col(p + "code").isin(*THUNDERSTORM_CODES), F.lit(False))


def is_heavy_rain(p: str = "") -> Column:
    heavy = F.when(_daily(p), HEAVY_RAIN_MM_PER_DAY).otherwise(HEAVY_RAIN_MM_PER_HOUR * F.col(p + "period_h"))
    return (F.col(p + "precip_mm") >= heavy) | F.coalesce(F.col(p + "code").isin(*HEAVY_RAIN_CODES), F.lit(False))


def hazards(p: str = "") -> Column:
    """Sorted array of hazard labels present in the row."""
    return F.array_compact(F.array(
        F.when(is_storm(p), F.lit(STORM)),
        F.when(is_heavy_rain(p), F.lit(HEAVY_RAIN)),
        F.when(F.col(p + "wind_kmh") >= ROUGH_SEA_WIND_KMH, F.lit(ROUGH_SEA)),
    ))


def hazard_overlap(present: Column, unsafe: Column) -> Column:
    return F.array_sort(F.array_intersect(present, unsafe))


def unsafe_reason(unsafe: Column, p: str = "") -> Column:
    """Readable hazards that forbid the place, NULL when it is safe."""
    hit = hazard_overlap(hazards(p), F.coalesce(unsafe, F.array().cast("array<string>")))
    names = F.transform(hit, lambda h: F.when(h == STORM, HAZARD_LABEL[STORM])
                        .when(h == HEAVY_RAIN, HAZARD_LABEL[HEAVY_RAIN]).otherwise(HAZARD_LABEL[ROUGH_SEA]))
    return F.when(F.size(hit) > 0, F.array_join(names, ", "))


def is_stormy(p: str = "") -> Column:
    """Heavy rain or storm: the weather that changes how to travel. False without a row."""
    return F.coalesce(is_storm(p) | is_heavy_rain(p), F.lit(False))


def _unit_range(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def rain_score(p: str = "") -> Column:
    full = F.when(_daily(p), F.lit(30.0)).otherwise(5.0 * F.col(p + "period_h"))
    amount = F.least(F.col(p + "precip_mm") / full, F.lit(1.0))
    return F.greatest(amount, 0.7 * F.coalesce(F.col(p + "rain_prob"), F.lit(0.0)) / 100.0)


def heat_score(p: str = "") -> Column:
    return _unit_range((F.col(p + "temp_c") - 32.0) / 6.0)


def wind_score(p: str = "") -> Column:
    return _unit_range((F.col(p + "wind_kmh") - 20.0) / 30.0)


def weather_cost(indoor_ratio: Column, sensitivity: Column, p: str = "") -> Column:
    """0..1 discomfort of being at the place during the row."""
    def weight(kind: str) -> Column:
        return F.coalesce(F.try_element_at(sensitivity, F.lit(kind)), F.lit(SENSITIVITY_DEFAULT[kind]))

    exposure = weight("rain") * rain_score(p) + weight("heat") * heat_score(p) + weight("wind") * wind_score(p)
    return F.least((1.0 - indoor_ratio) * exposure, F.lit(1.0))


def travel_factor(p: str = "") -> Column:
    """Travel-time multiplier; 1.0 when there is no weather row."""
    return (F.when(F.col(p + "precip_mm").isNull(), 1.0).when(is_storm(p), 1.8)
            .when(is_heavy_rain(p), 1.4).when(is_raining(p), 1.2).otherwise(1.0))
