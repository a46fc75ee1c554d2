"""Column-name rules. They work on name lists on the driver and never touch rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values: (short name, published name, score suffix, rank suffix, decile suffix).
_RANK = "Rank (where 1 is most deprived)"
_DECILE = "Decile (where 1 is most deprived 10% of LSOAs)"
_INDICES = [
    ("Overall", "Index of Multiple Deprivation (IMD)", "Score", _RANK, _DECILE),
    ("Income", "Income", "Score (rate)", _RANK, _DECILE),
    ("Employment", "Employment", "Score (rate)", _RANK, _DECILE),
    ("Education", "Education, Skills and Training", "Score", _RANK, _DECILE),
    ("Health", "Health Deprivation and Disability", "Score", _RANK, _DECILE),
    ("Crime", "Crime", "Score", _RANK, _DECILE),
    ("HousingBarriers", "Barriers to Housing and Services", "Score", _RANK, _DECILE),
    ("Environment", "Living Environment", "Score", _RANK, _DECILE),
    ("IncomeDeprChildren", "Income Deprivation Affecting Children Index (IDACI)", "Score (rate)", _RANK, _DECILE),
    ("IncomeDeprOlder", "Income Deprivation Affecting Older People (IDAOPI)", "Score (rate)", _RANK, _DECILE),
    # The published file cuts this decile header short.
    ("Services4Young", "Children and Young People Sub-domain", "Score", _RANK, "Decile (where 1 is most deprived 10% of LSO"),
    ("AdultSkills", "Adult Skills Sub-domain", "Score", _RANK, _DECILE),
    ("GeographicalBarriers", "Geographical Barriers Sub-domain", "Score", _RANK, _DECILE),
    ("WiderBarriers", "Wider Barriers Sub-domain", "Score", _RANK, _DECILE),
    ("IndoorLiving", "Indoors Sub-domain", "Score", _RANK, _DECILE),
    ("OutdoorLiving", "Outdoors Sub-domain", "Score", _RANK, _DECILE),
]
_OTHERS = {
    "LSOA code (2021)": "LSOACode",
    "LSOA name (2021)": "AreaName",
    "Local Authority District code (2024)": "LADCode",
    "Local Authority District name (2024)": "LADName",
    "Total population: mid 2022": "TotalPopulation",
    "Dependent Children aged 0-15: mid 2022": "DependentChildren",
    "Older population aged 60 and over: mid 2022": "Population60Plus",
    "Working age population 18-66 (for use with Employment Deprivation Domain): mid 2022": "WorkingAgePopulation",
}

# Abbreviations in the older column codes, applied in this order.
_ABBREVIATIONS = {
    "IMD": "Overall",
    "Inc": "Income",
    "Emp": "Employment",
    "HDD": "Health",
    "Cri": "Crime",
    "BHS": "HousingBarriers",
    "Env": "Environment",
    "Edu": "Education",
    "IDC": "IncomeDeprChildren",
    "IDO": "IncomeDeprOlder",
    "CYP": "Services4Young",
    "AS": "AdultSkills",
    "GB": "GeographicalBarriers",
    "WB": "WiderBarriers",
    "Ind": "IndoorLiving",
    "Out": "OutdoorLiving",
}


def indicator_names() -> dict[str, str]:
    """Published column headers of the indicator file and their short names."""
    names = dict(_OTHERS)
    for short, published, *suffixes in _INDICES:
        for kind, suffix in zip(("Score", "Rank", "Decile"), suffixes):
            names[f"{published} {suffix}"] = f"{short}{kind}"
    return names


def rename_indicators(df: DataFrame) -> DataFrame:
    """Give the indicator columns their short names; columns without an entry keep theirs."""
    return df.withColumnsRenamed(indicator_names())


def expand_abbreviations(name: str) -> str:
    """Spell out the abbreviations of an older column code, one after the other."""
    for short, full in _ABBREVIATIONS.items():
        name = name.replace(short, full)
    return name


def pascal_name(name: str) -> str:
    """``avg_price`` to ``AvgPrice``; a name without underscore only gets a capital; geometry stays."""
    if name == "geometry":
        return name
    if "_" in name:
        return "".join(word.title() for word in name.split("_"))
    return name[:1].upper() + name[1:]


def with_pascal_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[pascal_name(name) for name in df.columns])


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the columns a colour scale or an axis can use, sorted."""
    return sorted(f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType))


def available(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """Those of the wanted columns that exist, in the wanted order."""
    present = set(df.columns)
    return [name for name in wanted if name in present]
