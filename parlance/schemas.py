"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = ["id", "group_name"]

# The columns of the raw dump files, in file order.
RAW_MESSAGE = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("user_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("bot_flag", T.BooleanType()),
        T.StructField("via_bot_id", T.LongType()),
        T.StructField("via_business_bot_id", T.LongType()),
        T.StructField("reply_to_msg_id", T.LongType()),
        T.StructField("fwd_flag", T.BooleanType()),
        T.StructField("fwd_from_id", T.LongType()),
        T.StructField("media_type", T.StringType()),
        T.StructField("views", T.IntegerType()),
        T.StructField("forwards", T.IntegerType()),
        T.StructField("replies", T.IntegerType()),
        T.StructField("reactions", T.IntegerType()),
        T.StructField("reaction_json", T.StringType()),
    ]
)

# The six score columns of the toxicity stage.
TOXICITY_SCORES = ["toxicity", "severe_toxicity", "obscene", "threat", "insult", "identity_attack"]

EXPERIMENT_LOG = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("embedding", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("fold", T.IntegerType()),
        T.StructField("best_params", T.StringType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("f1_macro", T.DoubleType()),
        T.StructField("f1_weighted", T.DoubleType()),
    ]
)

GRID_RESULT_METRICS = T.StructType(
    [
        T.StructField("n_topics", T.IntegerType()),
        T.StructField("silhouette", T.DoubleType()),
        T.StructField("diversity", T.DoubleType()),
        T.StructField("coherence_cv", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)

REACTIONS = T.MapType(T.StringType(), T.IntegerType())
