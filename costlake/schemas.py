"""Table schemas of the cost model, written out so that no read infers one."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 8)
_TEXT_MAP = T.MapType(T.StringType(), T.StringType())


def _struct(spec: str, **special: T.DataType) -> T.StructType:
    """``name:type`` pairs; a trailing ``!`` marks a required column."""
    simple = {
        "str": T.StringType(), "ts": T.TimestampType(), "date": T.DateType(),
        "bool": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(),
        "dbl": T.DoubleType(), "map": _TEXT_MAP, "money": MONEY,
    }
    fields = []
    for part in spec.split():
        name, kind = part.split(":")
        required = kind.endswith("!")
        kind = kind.rstrip("!")
        fields.append(T.StructField(name, special.get(kind) or simple[kind], not required))
    return T.StructType(fields)


COST_RECORDS = _struct(
    "id:str! cloud_account_id:str! date:ts! granularity:str! service:str! region:str "
    "resource_id:str amount:money! currency:str! tags:map record_metadata:map"
)

CLOUD_ACCOUNTS = _struct(
    "id:str! organization_id:str! provider:str! account_id:str! account_name:str! "
    "business_unit:str environment:str cost_center:str is_active:bool! created_at:ts"
)

SYNC_RESULTS = _struct(
    "cloud_account_id:str! finished_at:ts! status:str! records_imported:long error:str"
)

BUDGETS = _struct(
    "id:str! organization_id:str! name:str! amount:budget! period:str! filters:map "
    "alert_thresholds:ints is_active:bool!",
    budget=T.DecimalType(18, 2), ints=T.ArrayType(T.IntegerType()),
)

COST_ANOMALIES = _struct(
    "cloud_account_id:str anomaly_date:date service:str region:str expected_amount:dbl "
    "actual_amount:dbl deviation_percent:dbl severity:str status:str"
)

NOTIFICATION_CHANNELS = _struct(
    "id:str! organization_id:str! channel_type:str! events:strs is_active:bool!",
    strs=T.ArrayType(T.StringType()),
)

METRIC_SAMPLES = _struct("ts:ts! metric:str! labels:map! value:dbl!")

CHAT_MESSAGES = _struct(
    "conversation_id:str! user_id:str! role:str! content:str! created_at:ts!"
)

AUDIT_LOGS = _struct(
    "organization_id:str! user_id:str action:str! resource_type:str! resource_id:str "
    "details:map ip_address:str created_at:ts!"
)

SYNC_TASK = _struct("type:str account_id:str organization_id:str days:int")

_MONEY_TEXT = T.StructType(
    [T.StructField("Amount", T.StringType()), T.StructField("Unit", T.StringType())]
)

#: One page of the AWS cost response.
AWS_PAGE = T.StructType([
    T.StructField("ResultsByTime", T.ArrayType(T.StructType([
        T.StructField("TimePeriod", T.StructType([
            T.StructField("Start", T.StringType()), T.StructField("End", T.StringType()),
        ])),
        T.StructField("Groups", T.ArrayType(T.StructType([
            T.StructField("Keys", T.ArrayType(T.StringType())),
            T.StructField("Metrics", T.StructType([
                T.StructField("UnblendedCost", _MONEY_TEXT),
                T.StructField("UsageQuantity", _MONEY_TEXT),
            ])),
        ]))),
    ]))),
])

#: One infrastructure plan; only the parts pricing reads.
PLAN_DOCUMENT = T.StructType([
    T.StructField("resource_changes", T.ArrayType(T.StructType([
        T.StructField("address", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("change", T.StructType([
            T.StructField("actions", T.ArrayType(T.StringType())),
            T.StructField("before", _TEXT_MAP),
            T.StructField("after", _TEXT_MAP),
        ])),
    ]))),
])
