"""Declared schemas; nothing in this package infers one.

Column names and types of the raw trajectory table, of a frame message and of a window message
are fixed values of the data sets and topics they describe.
"""

from pyspark.sql.types import (
    ArrayType,
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(*fields: tuple[str, DataType]) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in fields])


TRAJECTORY = _struct(
    ("Vehicle_ID", IntegerType()),
    ("Frame_ID", IntegerType()),
    ("Total_Frames", IntegerType()),
    ("Global_Time", LongType()),
    ("Local_X", DoubleType()),
    ("Local_Y", DoubleType()),
    ("Global_X", DoubleType()),
    ("Global_Y", DoubleType()),
    ("v_length", DoubleType()),
    ("v_Width", DoubleType()),
    ("v_Class", IntegerType()),
    ("v_Vel", DoubleType()),
    ("v_Acc", DoubleType()),
    ("Lane_ID", IntegerType()),
    ("O_Zone", IntegerType()),
    ("D_Zone", IntegerType()),
    ("Int_ID", IntegerType()),
    ("Section_ID", IntegerType()),
    ("Direction", IntegerType()),
    ("Movement", IntegerType()),
    ("Preceding", IntegerType()),
    ("Following", IntegerType()),
    ("Space_Headway", DoubleType()),
    ("Time_Headway", DoubleType()),
    ("Location", StringType()),
)


def frame_point(speed: DataType | None = None) -> StructType:
    """One vehicle inside a frame message. A decimal ``speed`` makes its averages exact."""
    speed = speed or DoubleType()
    return _struct(
        ("Global_Time", LongType()),
        ("ElapsedTime", LongType()),
        ("Vehicle_ID", LongType()),
        ("Global_X", DoubleType()),
        ("Global_Y", DoubleType()),
        ("Local_X", DoubleType()),
        ("Local_Y", DoubleType()),
        ("v_Vel", speed),
        ("v_Acc", speed),
        ("Lane_ID", IntegerType()),
        ("Location", StringType()),
    )


SECTION_AGG = _struct(
    ("location", StringType()),
    ("elapsed_time", LongType()),
    ("section_id", IntegerType()),
    ("lane_id", IntegerType()),
    ("avg_vel", DoubleType()),
    ("avg_acc", DoubleType()),
    ("n", LongType()),
)

TOPIC = _struct(("key", StringType()), ("value", StringType()))

TIME_WINDOW = _struct(("start", TimestampType()), ("end", TimestampType()))

WINDOW_KEY = _struct(("location", StringType()), ("timewindow", TIME_WINDOW))

VELOCITY_MATRIX = ArrayType(ArrayType(ArrayType(IntegerType())))

METRICS = _struct(
    ("model_name", StringType()),
    ("mae", DoubleType()),
    ("mape", DoubleType()),
    ("maape", DoubleType()),
    ("rmse", DoubleType()),
)
