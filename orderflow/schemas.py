"""Record schemas and code tables. Schemas are always explicit, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, INT, DOUBLE = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def struct(*strings: str, **others: T.DataType) -> T.StructType:
    return T.StructType([*(T.StructField(n, STRING) for n in strings), *(T.StructField(n, t) for n, t in others.items())])


#: Wire key of an order event -> column, in the records' order.
ORDER_WIRE = {
    "order_id": "orderID",
    "user_id": "userID",
    "product_id": "productID",
    "product_pub": "pubID",
    "user_mobile": "userMobile",
    "user_region": "userRegion",
    "product_traffic": "traffic",
    "product_traffic_grade": "trafficGrade",
    "product_traffic_type": "trafficType",
    "product_price": "price",
    "product_fee": "fee",
    "has_activity": "hasActivity",
    "travel_member_adult": "adult",
    "travel_member_yonger": "yonger",
    "travel_member_baby": "baby",
    "order_ct": "ct",
}
ORDER_NUMBERS = {"price": "int", "fee": "int", "ct": "bigint"}

ORDER_DETAIL = struct(
    "orderID", "userID", "productID", "pubID", "userMobile", "userRegion", "traffic", "trafficGrade", "trafficType",
    "hasActivity", "adult", "yonger", "baby", price=INT, fee=INT, ct=LONG,
)
#: Columns that the product dimension adds, with the dimension's names.
PRODUCT_COLUMNS = {
    "productLevel": "product_level",
    "productType": "product_type",
    "toursimType": "toursim_tickets_type",
    "depCode": "departure_code",
    "desCode": "des_city_code",
}
PUB_COLUMNS = {"pubStar": "pub_star", "pubGrade": "pub_grade", "isNational": "is_national"}
ORDER_WIDE = T.StructType([*ORDER_DETAIL.fields, *struct("productType", "toursimType", "depCode", "desCode", productLevel=INT).fields])
ORDER_MWIDE = T.StructType([*ORDER_WIDE.fields, *struct("pubStar", "pubGrade", "isNational").fields])

USER_LOG = struct(
    "sid", "userDevice", "userDeviceType", "os", "userID", "userRegion", "userRegionIP", "lonitude", "latitude",
    "manufacturer", "carrier", "networkType", "duration", "exts", "action", "eventType", ct=LONG,
)
VIEW_LIST = T.StructType([*USER_LOG.fields, T.StructField("hotTarget", STRING)])
PAGE_VIEW = T.StructType([*(f for f in USER_LOG.fields if f.name != "exts"), T.StructField("targetID", STRING)])
PAGE_VIEW_ALERT = struct("userDevice", "userID", "userRegion", "userRegionIP", "duration", ct=LONG)
CLICK = T.StructType([*(f for f in USER_LOG.fields if f.name not in ("exts", "duration")), *struct("targetID", "eventTargetType").fields])
LIST_EXTS = ("travelSend", "travelSendTime", "travelTime", "productLevel", "productType")
VIEW_LIST_FACT = T.StructType([*(f for f in VIEW_LIST.fields if f.name != "exts"), *struct("targetID", *LIST_EXTS).fields])
TOPN = struct("productID", "traffic", startWindowTime=LONG, endWindowTime=LONG, orders=LONG, totalFee=LONG)

DIM_PRODUCT = struct("product_id", "product_type", "departure_code", "des_city_code", "toursim_tickets_type", product_level=INT)
DIM_PUB = struct("pub_id", "pub_name", "pub_star", "pub_grade", "is_national")

#: Action and event codes of behaviour logs.
ACTIONS = {"install": "01", "launch": "02", "interactive": "05", "page_enter_h5": "07", "page_enter_native": "08"}
EVENTS = {"view": "01", "click": "02", "input": "03", "slide": "04"}
PAGE_ACTIONS, LIST_EVENTS = ("07", "08"), ("01", "04")
