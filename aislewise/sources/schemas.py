"""Declared schemas of the retail tables (a missing column fails at load)."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "f": T.DoubleType(),
          "d": T.DateType(), "t": T.TimestampType(), "b": T.BooleanType()}


def _schema(text: str) -> T.StructType:
    fields = []
    for item in text.split():
        name, kind = item.split(":")
        fields.append(T.StructField(name, _TYPES[kind], True))
    return T.StructType(fields)


# The columns of the 25 source tables.
SCHEMAS: dict[str, T.StructType] = {
    name: _schema(columns) for name, columns in {
        "stores": "store_id:s store_name:s city:s region:s tier:s store_type:s size_sqft:i "
                  "open_date:d is_active:b",
        "warehouses": "warehouse_id:s warehouse_name:s city:s region:s type:s capacity_sqft:i "
                      "is_active:b",
        "suppliers": "supplier_id:s name:s category:s country:s city:s payment_terms:s "
                     "lead_time_days:i min_order_qty:i reliability_score:f is_active:b",
        "employees": "employee_id:s store_id:s name:s role:s join_date:d salary:i "
                     "performance_score:f is_active:b",
        "holiday_calendar": "date:d year:i month:i day_of_week:s is_weekend:b is_holiday:b "
                            "holiday_name:s is_sale_season:b season:s is_long_weekend:b",
        "weather": "date:d city:s temperature_c:f rainfall_mm:f humidity_pct:i "
                   "weather_condition:s",
        "customers": "customer_id:s name:s gender:s city:s region:s income_bracket:s segment:s "
                     "preferred_channel:s preferred_category:s loyalty_tier:s email:s phone:s "
                     "age:i shopping_frequency:f registration_date:d is_active:b "
                     "app_installed:b email_opt_in:b sms_opt_in:b",
        "products": "product_id:s product_name:s category:s sub_category:s brand:s color:s "
                    "size:s style_tag:s season:s supplier_id:s price:f mrp:f cost_price:f "
                    "launch_date:d is_active:b weight_grams:i",
        "transactions": "transaction_id:s customer_id:s product_id:s store_id:s channel:s "
                        "payment_method:s quantity:i unit_price:f discount_pct:f final_price:f "
                        "total_amount:f transaction_date:d is_returned:b",
        "browsing_history": "browse_id:s customer_id:s product_id:s device:s source:s "
                            "page_views:i dwell_seconds:i timestamp:t added_to_cart:b "
                            "purchased:b",
        "customer_sessions": "session_id:s customer_id:s device:s channel:s login_time:t "
                             "logout_time:t duration_mins:i pages_visited:i date:d",
        "wishlist": "wishlist_id:s customer_id:s product_id:s added_date:d is_purchased:b",
        "shopping_cart": "cart_id:s customer_id:s product_id:s quantity:i added_at:t status:s",
        "search_history": "search_id:s customer_id:s query_text:s clicked_product_id:s "
                          "timestamp:t results_count:i converted:b",
        "inventory": "inventory_id:s product_id:s store_id:s warehouse_id:s location_type:s "
                     "stock_qty:i reorder_point:i max_stock:i days_on_hand:f last_updated:d",
        "inventory_movements": "movement_id:s inventory_id:s from_location:s to_location:s "
                               "quantity:i reason:s approved_by:s movement_date:d",
        "pricing_history": "price_id:s product_id:s store_id:s price_type:s price:f "
                           "effective_date:d created_by:s",
        "competitor_pricing": "comp_price_id:s product_id:s competitor_name:s price:f "
                              "scraped_date:d in_stock:b source_url:s",
        "promotions": "promo_id:s product_id:s promo_type:s channel:s target_segment:s "
                      "discount_pct:f start_date:d end_date:d budget:i is_active:b",
        "marketing_campaigns": "campaign_id:s promo_id:s campaign_name:s channel:s "
                               "target_segment:s status:s budget:i amount_spent:f "
                               "impressions:i clicks:i conversions:i start_date:d end_date:d",
        "orders": "order_id:s customer_id:s product_id:s store_id:s status:s delivery_city:s "
                  "quantity:i shipping_fee:i unit_price:f total_amount:f order_date:d "
                  "estimated_delivery:d actual_delivery:d",
        "shipments": "shipment_id:s order_id:s supplier_id:s warehouse_id:s product_id:s "
                     "status:s carrier:s quantity:i ship_date:d expected_arrival:d "
                     "actual_arrival:d freight_cost:f",
        "support_tickets": "ticket_id:s customer_id:s order_id:s category:s priority:s "
                           "description:s status:s channel:s agent_id:s created_at:t "
                           "resolved_at:t csat_score:i",
        "returns": "return_id:s order_id:s customer_id:s product_id:s reason:s status:s "
                   "return_date:d refund_amount:f",
        "customer_reviews": "review_id:s customer_id:s product_id:s order_id:s review_text:s "
                            "sentiment_label:s rating:i helpful_votes:i review_date:d "
                            "is_verified:b",
    }.items()
}
