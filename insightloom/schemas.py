"""Table schemas of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, B, L = T.StringType(), T.DoubleType(), T.BooleanType(), T.LongType()


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: A process parameter's value: number, truth value or text.
PARAM_VALUE = struct(d=D, b=B, s=S)

INFLUENCE = struct(value=PARAM_VALUE, influential=B)
UI_CHANGE = struct(label=S, user_value=S, key=S, original_value=S, extruder=S, category=S)
LAST_RATING = struct(experiment_id=L, items=T.MapType(S, struct(value=D, influential=B)))
MATERIAL = struct(color=S, type=S, producer=S)
MEASUREMENT = struct(humidity=D, temperature=D, time=T.TimestampType())
INSIGHTS = struct(comment=S, user_id=S, uncertainty=D, influences=T.ArrayType(T.MapType(S, INFLUENCE)), changed_ui_parameters=T.ArrayType(UI_CHANGE), last_rating_influences=T.ArrayType(LAST_RATING))

EXPERIMENT = struct(
    exp_id=L, series_id=S, printer=S, stl_file_id=S, oneoff=B, completion=D, material=MATERIAL,
    all_parameters=T.MapType(S, PARAM_VALUE), changed_parameters=T.MapType(S, PARAM_VALUE),
    measurements=T.ArrayType(MEASUREMENT), ratings=T.ArrayType(T.MapType(S, D)), insights=INSIGHTS,
)

INSIGHT_EDGE = struct(exp_id=L, influence=S, influence_type=S, parameter=S, weight=D)
VERTEX_VALUE = struct(exp_id=L, key=S, type=S, value=D, user_value=D, original_value=D)
KG_EDGE = struct(influence=S, parameter=S, influence_type=S, weight=D, experiments=T.ArrayType(L))
METRIC_FRAME = struct(frame=S, series_id=S, exp_id=L, key=S, value=D)
RULE = struct(condition=S, cond_lo=D, cond_hi=D, action=S, parameter=S, param_type=S, mean_value=D, range_start=D, range_end=D, step_size=D, quantifier=D)
RELATION = struct(parameter=S, quality=S, mean=D, scopes=T.ArrayType(struct(lo=D, hi=D)), values=T.ArrayType(D), action=S)
REP_VERTEX = struct(kg_type=S, name=S, type=S, literal_value=S, corresponding_parameter=S)
REP_EDGE = struct(kg_type=S, src=S, dst=S, rel=S, literal_included=S)
TRIPLE = struct(split=S, h=S, r=S, t=S)
EMBEDDING = struct(vid=L, vec=T.ArrayType(D))
METRIC = struct(kg_type=S, method=S, side=S, metric=S, k=T.IntegerType(), iteration=T.IntegerType(), value=D)
