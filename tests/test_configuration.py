import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import tuples
from elastiq.functions import checks
from elastiq.operators import entities, groups, tiers

KEYS = ["entity_id", "country_code"]
OLD, NEW = dt.datetime(2023, 1, 1), dt.datetime(2023, 6, 1, 12, 0, 0, 500)


def _entity(*ids, region="Asia", iso="SG"):
    return {"region": region, "country_iso": iso, "country_name": "n", "platforms": [(i,) for i in ids]}


def test_active_entities(make):
    orders = make("orders_mapped", *[{"entity_id": e} for e in ("ODR_1", "DN_X", "DNX", "FP_DE", "FP_SG", "BM_VN", "FP_SG")])
    source = make("entities", _entity("ODR_1", "DN_X", "DNX", "FP_DE", "FP_SG", "BM_VN", "FP_MY"), _entity())
    active = entities.active_entities(source, orders)
    assert tuples(active, "region", "entity_id", "country_code") == [("Asia", "FP_SG", "sg")]
    lite = entities.entities_lite(source, orders)
    assert tuples(lite, "entity_id", "country_iso") == [("BM_VN", "SG"), ("FP_SG", "SG")]


def _active(spark):
    return spark.createDataFrame([("Asia", "E", "sg", "n")], "region string, entity_id string, country_code string, country_name string")


def test_active_zones(make, spark):
    shape = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]]

    def city(id_, active, *zones):
        return (id_, f"c{id_}", active, [(z, f"z{z}", on, shape) for z, on in zones])

    cities = [city(1, True, (10, True), (11, False)), city(2, False, (20, True)), city(3, True)]
    source = make(
        "countries",
        {"region": "Asia", "country_code": "sg", "platforms": [("E",), ("F",)], "cities": cities},
        {"region": "Asia", "country_code": "my", "platforms": [("E",)], "cities": cities},
        {"region": "Asia", "country_code": "sg", "platforms": [("E",)], "cities": None},
    )
    zones = entities.active_zones(source, _active(spark))
    assert tuples(zones, *KEYS, "city_name", "zone_name", "zone_id") == [("E", "sg", "c1", "z10", 10)]


def _config(scheme, since, until=None, schedule=(), customers=()):
    return (scheme, 7, 1, since, until, [(i,) for i in schedule], [(i,) for i in customers])


def _vendor(code, *versions):
    return {"entity_id": "E", "country_code": "sg", "vendor_code": code, "dps_automatic_assignment_history": list(versions)}


def test_current_setups(make, spark):
    source = make(
        "group_config_versions",
        _vendor("v1", (1, "Food", 3, OLD, NEW, [_config(5, NEW)]), (1, "Food", 3, NEW, None, [_config(5, OLD), _config(6, NEW)])),
        _vendor("v2", (1, "Food", 3, NEW, None, [_config(6, NEW), _config(8, NEW, None, (1, 2), (3,))])),
        # the price setup of v3 did not change when that of the group did
        _vendor("v3", (1, "Food", 3, NEW, None, [_config(5, OLD)])),
        _vendor("v4", (2, "Shop", 3, None, None, [_config(5, NEW)]), (3, "Gone", 3, NEW, NEW, [_config(5, NEW)])),
        _vendor("v5"),
    )
    setups = groups.current_setups(groups.newest_versions(source, _active(spark)))
    assert tuples(setups, "vendor_code", "scheme_id", "time_condition_id", "customer_condition_id") == [
        ("v1", 6, None, None),
        ("v2", 6, None, None),
        ("v2", 8, 1, 3),
        ("v2", 8, 2, 3),
    ]
    assert setups.select("vendor_count_caught_by_asa").distinct().collect() == [(2,)]
    assert setups.select("asa_setup_active_from").first()[0] == dt.datetime(2023, 6, 1, 12)


def _setups(spark, *rows):
    """Rows of (entity, group id, name, vendor, scheme, time condition)."""
    schema = (
        "region string, entity_id string, country_code string, asa_id long, asa_name string, vendor_code string,"
        " scheme_id long, time_condition_id long"
    )
    df = spark.createDataFrame([("Asia", e, "sg", *rest) for e, *rest in rows], schema)
    missing = {
        "asa_priority": "int", "asa_setup_active_from": "timestamp", "asa_setup_active_from_max_date": "timestamp",
        "asa_setup_active_to": "timestamp", "vendor_group_price_config_id": "long", "condition_priority": "int",
        "customer_condition_id": "long", "pc_setup_active_from": "timestamp",
        "pc_setup_active_from_max_date": "timestamp", "pc_setup_active_to": "timestamp",
        "vendor_count_caught_by_asa": "long",
    }
    return df.withColumns({c: F.lit(None).cast(t) for c, t in missing.items()})


def _named(spark):
    return _setups(
        spark,
        ("E", 1, "Food", "a", 1, None),
        ("E", 2, "Food_LB", "b", 1, None),
        ("E", 3, "Shop", "c", 2, None),
        ("E", 4, "shop_lb", "d", 2, 9),
        ("E", 5, "Rest", "e", 2, None),
        ("F", 6, "Food_LB", "f", 1, None),
        ("E", 7, "LAB_BOB_LB", "g", 1, None),
        ("E", 8, "LAB_BOB", "h", 1, None),
    )


def test_linked_groups_share_one_master_id(spark):
    setups = _named(spark)
    links = groups.linked_groups(setups)
    assert tuples(links, "asa_id", "linked_asa", "asa_common_name") == [
        (1, "Food_LB", "Food"),
        (2, "Food", "Food"),
        (3, "shop_lb", "Shop"),
        (4, "Shop", "shop_lb"),
        (7, "LAB_BOB", "AB_BO"),
        (8, "LAB_BOB_LB", "AB_BO"),
    ]
    linked = groups.with_master_id(setups, links)
    assert tuples(linked, "asa_id", "master_asa_id", "is_asa_clustered") == [
        (1, 9, True), (2, 9, True), (3, 9, True), (4, 9, True), (5, 5, False), (6, 6, False), (7, 9, True), (8, 9, True),
    ]


def test_linking_options(spark):
    setups = _named(spark)
    links = groups.linked_groups(setups, suffix_only=True)
    linked = groups.with_master_id(setups, links, per_pair_ids=True)
    assert tuples(linked.filter("is_asa_clustered"), "asa_id", "master_asa_id", "asa_common_name") == [
        (1, 9, "Food"), (2, 9, "Food"), (3, 11, "Shop"), (4, 11, "Shop"), (7, 10, "LAB_BOB"), (8, 10, "LAB_BOB"),
    ]


def test_a_group_linked_twice_appears_twice(spark):
    setups = _setups(spark, ("E", 1, "A", "a", 1, None), ("E", 2, "A_LB", "b", 1, None), ("E", 3, "A_LB_LB", "c", 1, None))
    linked = groups.with_master_id(setups, groups.linked_groups(setups))
    assert tuples(linked, "asa_id", "master_asa_id") == [(1, 4), (2, 4), (2, 4), (3, 4)]


def test_chains_of_linked_names(spark):
    names = ["A", "a_lb", "A_LB", "A_LB_LB", "B_LB", "B_LB_LB_LB", "C", "C_LB", "", "_LB", "D\nD", "D\nD_lb", "Z", None]
    setups = _setups(spark, *[("E", i, n, "v", 1, None) for i, n in enumerate(names)], ("F", 20, "C_LB", "v", 1, None), ("E", 0, "A", "w", 1, None))
    found = checks.linked_chains(setups)
    assert tuples(found, "asa_id", "chain_name", "chain_place", "chain_names", "chain_groups", "n_links", "repeats_rows") == [
        (0, "a", 1, 3, 4, 2, True),
        (1, "a", 2, 3, 4, 2, True),
        (10, "d\nd", 1, 2, 2, 1, False),
        (11, "d\nd", 2, 2, 2, 1, False),
        (2, "a", 2, 3, 4, 2, True),
        (3, "a", 3, 3, 4, 2, True),
        (6, "c", 1, 2, 2, 1, False),
        (7, "c", 2, 2, 2, 1, False),
        (8, "", 1, 2, 2, 1, False),
        (9, "", 2, 2, 2, 1, False),
    ]
    # as many links as the step itself makes rows
    links = groups.linked_groups(setups).groupBy("asa_id").count()
    assert tuples(links, "asa_id", "count") == tuples(found, "asa_id", "n_links")
    with pytest.raises(ValueError):
        checks.linked_chains(setups, suffix="")


def test_suffixes_that_overlap_themselves(spark):
    setups = _setups(spark, *[("E", n, "1" * n, "v", 1, None) for n in range(1, 8)])
    found = checks.linked_chains(setups, suffix="11")
    assert tuples(found, "asa_id", "chain_name", "chain_place") == [
        (1, "1", 1), (2, "11", 1), (3, "1", 2), (4, "11", 2), (5, "1", 3), (6, "11", 3), (7, "1", 4),
    ]


def test_members_and_schemes(spark):
    linked = groups.with_master_id(_named(spark), groups.linked_groups(_named(spark)))
    assert "d" not in [r[0] for r in groups.vendors_per_group(linked).select("vendor_code").collect()]
    schemes = groups.schemes_per_group(linked)
    assert tuples(schemes.filter("asa_id IN (3, 4)"), "asa_id", "scheme_type") == [(3, "Main Scheme"), (4, "Condition Scheme")]


def _schemes(spark, *rows):
    schema = (
        "region string, entity_id string, country_code string, asa_id long, master_asa_id long, asa_name string,"
        " asa_common_name string, vendor_count_caught_by_asa long, scheme_id long, scheme_type string"
    )
    return spark.createDataFrame([("Asia", "E", "sg", a, a, "n", "n", 1, s, t) for a, s, t in rows], schema)


def test_fee_tiers(make, spark):
    source = make(
        "scheme_config_versions",
        {
            "region": "Asia", "entity_id": "E", "country_code": "sg", "scheme_id": 1,
            "price_scheme_history": [("old", OLD, None, 5), ("new", NEW, None, 6), ("closed", NEW, NEW, 7)],
            "travel_time_config": [("old", OLD, None), ("new", NEW, None)],
            "travel_time_detail": [(10.5, 1.0, NEW, None), (20.0, 2.0, OLD, None), (None, 3.0, NEW, None), (5.0, 0.5, OLD, NEW)],
        },
        # without details a scheme keeps one row with no fee; without a config it has none
        {
            "region": "Asia", "entity_id": "E", "country_code": "sg", "scheme_id": 2,
            "price_scheme_history": [("new", NEW, None, 6)], "travel_time_config": [("new", NEW, None)],
        },
        {"region": "Asia", "entity_id": "E", "country_code": "sg", "scheme_id": 3, "price_scheme_history": [("new", NEW, None, 6)]},
        {
            "region": "Asia", "entity_id": "E", "country_code": "sg", "scheme_id": 4,
            "price_scheme_history": [("new", NEW, None, 6)], "travel_time_config": [("new", NEW, None)],
        },
    )
    schemes = _schemes(spark, (1, 1, "Main Scheme"), (1, 2, "Main Scheme"), (1, 3, "Main Scheme"))
    found = tiers.scheme_fee_tiers(source, schemes)
    assert tuples(found.filter("scheme_id = 1"), "scheme_name", "config_name", "tier", "tt_threshold", "threshold_in_min_and_sec", "fee") == [
        ("new", "new", 1, 10.5, 10.3, 1.0),
        ("new", "new", 2, 20.0, 20.0, 2.0),
        ("new", "new", 3, 9999999.0, 9999999.0, 3.0),
    ]
    assert tuples(found.filter("scheme_id > 1"), "scheme_id", "tt_threshold", "fee", "tier") == [(2, 9999999.0, None, 1)]
    assert tuples(tiers.group_fee_tiers(found), "asa_id", "fee") == [(1, 1.0), (1, 2.0), (1, 3.0), (1, None)]
    # the rank counts the rows of every group that uses the scheme
    shared = _schemes(spark, (1, 1, "Main Scheme"), (2, 1, "Main Scheme"), (2, 1, "Condition Scheme"))
    assert tuples(tiers.scheme_fee_tiers(source, shared).filter("asa_id = 1"), "fee", "tier") == [(1.0, 1), (2.0, 4), (3.0, 7)]
