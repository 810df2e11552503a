"""Schemas of the input tables, as DDL."""

from __future__ import annotations

_POINT = "struct<x:double,y:double>"
_ZONE = f"struct<id:bigint,name:string,is_active:boolean,shape:array<array<{_POINT}>>>"
_CITY = f"struct<id:bigint,name:string,is_active:boolean,zones:array<{_ZONE}>>"
_ID = "struct<id:bigint>"
_PLATFORM = "struct<entity_id:string>"
_PRICE_CONFIG = (
    "struct<price_scheme_id:bigint,vendor_group_price_config_id:bigint,priority:int,"
    f"active_from:timestamp,active_to:timestamp,schedule:array<{_ID}>,customer_condition:array<{_ID}>>"
)
_GROUP_VERSION = (
    "struct<id:bigint,name:string,priority:int,active_from:timestamp,active_to:timestamp,"
    f"price_config:array<{_PRICE_CONFIG}>>"
)

SCHEMAS: dict[str, str] = {
    "entities": f"region string, country_iso string, country_name string, platforms array<{_PLATFORM}>",
    "countries": (
        f"region string, country_code string, platforms array<{_PLATFORM}>, cities array<{_CITY}>"
    ),
    "group_config_versions": (
        "entity_id string, country_code string, vendor_code string, "
        f"dps_automatic_assignment_history array<{_GROUP_VERSION}>"
    ),
    "scheme_config_versions": (
        "region string, entity_id string, country_code string, scheme_id bigint, "
        "price_scheme_history array<struct<scheme_name:string,active_from:timestamp,active_to:timestamp,"
        "travel_time_config_id:bigint>>, "
        "travel_time_config array<struct<config_name:string,active_from:timestamp,active_to:timestamp>>, "
        "travel_time_detail array<struct<travel_time_threshold:double,travel_time_fee:double,"
        "active_from:timestamp,active_to:timestamp>>"
    ),
    "web_sessions": (
        "created_date date, entity_id string, country_code string, platform string, brand string, "
        "events_ga_session_id string, fullvisitor_id string, visit_id string, has_transaction boolean, "
        "total_transactions bigint, ga_dps_session_id string, lon double, lat double, "
        "sessions struct<dps_session_timestamp:timestamp,endpoint:string,perseus_client_id:string,"
        "variant:string,experiment_id:string,vertical_parent:string,customer_status:string,location:string,"
        "variant_concat:string,location_concat:string,customer_status_concat:string>, "
        "events array<struct<event_action:string,vendor_code:string,vertical_type:string,"
        "event_time:timestamp,transaction_id:string,expedition_type:string>>, "
        "dps_zone array<struct<city_id:bigint,city_name:string,id:bigint,name:string,timezone:string>>"
    ),
    "orders_mapped": (
        "entity_id string, country_code string, vendor_id string, platform_order_code string, "
        "created_date date, delivery_status string, is_sent boolean, assignment_id string, "
        "vendor_price_scheme_type string, exchange_rate double, delivery_fee_local double, "
        "is_delivery_fee_covered_by_discount boolean, is_delivery_fee_covered_by_voucher boolean, "
        "dps_travel_time_fee_local double, commission_local double, joker_vendor_fee_local double, "
        "service_fee_local double, gfv_local double, dps_minimum_order_value_local double, "
        "delivery_costs_local double, gmv_local double"
    ),
    "external_fee_orders": (
        "global_entity_id string, code string, created_date_utc date, delivery_fee_local double"
    ),
    "pricing_requests": (
        "entity_id string, country_code string, created_date date, created_at timestamp, endpoint string, "
        "customer struct<user_id:string,lon:double,lat:double,session:struct<id:string,timestamp:timestamp>>, "
        "vendors array<struct<id:string,meta_data:struct<scheme_id:bigint,vendor_price_scheme_type:string>,"
        "delivery_fee:struct<travel_time:double,total:double>>>"
    ),
    "vendor_directory": "global_entity_id string, vendor_id string, vertical_type string",
    "order_values": "global_entity_id string, order_id string, value struct<mov_customer_fee_local:double>",
    "vendors_clustered": "region string, country_code string, vendor_id string, cluster string",
}
