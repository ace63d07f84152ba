"""The schemas of the engine."""

from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

MUTATIONS = StructType([StructField("seq", LongType(), False), StructField("op", StringType(), False), StructField("key", BinaryType(), False), StructField("value", BinaryType())])
ENTRIES = StructType([StructField("key", BinaryType(), False), StructField("okey", StringType(), False), StructField("value", BinaryType()), StructField("is_deleted", BooleanType(), False), StructField("seq", LongType(), False)])
MANIFEST = StructType(
    [
        StructField("file", StringType(), False),
        StructField("level", IntegerType(), False),
        StructField("file_seq", LongType(), False),
        StructField("n_entries", LongType(), False),
        StructField("n_deleted", LongType(), False),
        StructField("lo", StringType(), False),
        StructField("hi", StringType(), False),
        StructField("bytes", LongType(), False),
    ]
)
