"""Fixed schemas of the tables the readers return; nothing is inferred."""

from pyspark.sql import types as T


def _s(**cols) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols.items()])


TRACKS = _s(time=T.IntegerType(), agent_id=T.IntegerType(), tri_idx=T.LongType(), lat=T.DoubleType(), lon=T.DoubleType(),
            ed_kJ_g=T.DoubleType(), behavior=T.IntegerType(), alive=T.BooleanType(), arrived=T.BooleanType(),
            natal_reach_id=T.ByteType(), exit_branch_id=T.ByteType(), origin=T.ByteType(), sea_age=T.ByteType())
OLD_TRACK_COLUMNS = 9       # older files stop after `arrived`

SNAPSHOT = ["tri_idx", "alive", "behavior", "ed_kJ_g", "mass_g"]

LAYER = T.StructType([T.StructField("Hex ID", T.LongType()), T.StructField("Score", T.DoubleType())])

EDGE_OUTCOMES = _s(from_id=T.StringType(), to_id=T.StringType(), mortality=T.DoubleType(), deflection=T.DoubleType(),
                   transmission=T.DoubleType(), note=T.StringType())

GRIDDED = _s(time=T.IntegerType(), lat=T.DoubleType(), lon=T.DoubleType(), var=T.StringType(), value=T.DoubleType())

EVENTS = _s(event_id=T.LongType(), ts=T.TimestampNTZType(), user_id=T.LongType(), event_type=T.StringType(),
            value=T.DoubleType(), props=T.StringType())
