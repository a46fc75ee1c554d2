from propstats.functions import names


def test_pascal_names():
    cases = {
        "geometry": "geometry",
        "avg_price": "AvgPrice",
        "25th_percentile_price": "25ThPercentilePrice",
        "is_london?": "IsLondon?",
        "year": "Year",
        "PostDist": "PostDist",
        "roll_median_pct_5_year": "RollMedianPct5Year",
    }
    assert {k: names.pascal_name(k) for k in cases} == cases


def test_indicator_names():
    mapping = names.indicator_names()
    assert len(mapping) == 4 + 16 * 3 + 4
    assert mapping["Index of Multiple Deprivation (IMD) Score"] == "OverallScore"
    assert mapping["Income Score (rate)"] == "IncomeScore"
    assert mapping["Crime Rank (where 1 is most deprived)"] == "CrimeRank"
    cut = "Children and Young People Sub-domain Decile (where 1 is most deprived 10% of LSO"
    assert mapping[cut] == "Services4YoungDecile"
    assert mapping["Outdoors Sub-domain Decile (where 1 is most deprived 10% of LSOAs)"] == "OutdoorLivingDecile"


def test_abbreviations():
    assert names.expand_abbreviations("IMDScore") == "OverallScore"
    assert names.expand_abbreviations("ASRank") == "AdultSkillsRank"
    assert names.expand_abbreviations("OutDec") == "OutdoorLivingDec"


def test_column_selection(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "n int, s string, d double")
    assert names.numeric_columns(df) == ["d", "n"]
    assert names.available(df, ["d", "missing", "n"]) == ["d", "n"]
    assert names.with_pascal_names(df.toDF("a_b", "s", "geometry")).columns == ["AB", "S", "geometry"]
