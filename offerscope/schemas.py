"""Declared schemas of the three raw inputs and the derived tables."""

from pyspark.sql import types as T

# Raw offer catalogue, one JSON object per line.
PORTFOLIO = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("reward", T.IntegerType()),
    T.StructField("difficulty", T.IntegerType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("offer_type", T.StringType()),
    T.StructField("channels", T.ArrayType(T.StringType())),
])

# Raw customer profiles; became_member_on is a yyyymmdd integer.
PROFILE = T.StructType([
    T.StructField("gender", T.StringType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("id", T.StringType()),
    T.StructField("became_member_on", T.IntegerType()),
    T.StructField("income", T.DoubleType()),
])

# The ``value`` object of an event: keys vary by event type and the offer
# key is spelled two ways.
EVENT_VALUE = T.StructType([
    T.StructField("offer id", T.StringType()),
    T.StructField("offer_id", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("reward", T.DoubleType()),
])

# Raw events as JSON lines.  The value is kept as it is, whatever its keys.
TRANSCRIPT_JSON = T.StructType([
    T.StructField("person", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("value", T.VariantType()),
    T.StructField("time", T.IntegerType()),
])

# Raw events as a table (value is dict text, possibly with single quotes).
TRANSCRIPT_TEXT = T.StructType([
    T.StructField("person", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("time", T.IntegerType()),
])

# Flattened event log.
EVENTS = T.StructType([
    T.StructField("person", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("time", T.IntegerType()),
    T.StructField("offer_id", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("reward", T.DoubleType()),
])

EVENT_COLUMNS = [f.name for f in EVENTS.fields]
