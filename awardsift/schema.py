"""Canonical schemas."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


AWARD = _struct(
    piid=T.StringType(), description=T.StringType(), value=T.StringType(), end_date=T.StringType(),
    vendor=T.StringType(), agency=T.StringType(),
)
LABELED = _struct(
    piid=T.StringType(), agency=T.StringType(), vendor=T.StringType(), value=T.StringType(),
    description=T.StringType(), fpds_status=T.StringType(), fpds_link=T.StringType(),
    deleted_date=T.StringType(), savings=T.LongType(),
)
# Every column a dump file may bring that the engine reads; dumps have some 300 more.
RAW_DUMP = _struct(
    award_id_piid=T.StringType(), award_id_fain=T.StringType(),
    prime_award_base_transaction_description=T.StringType(),
    description=T.StringType(), award_description=T.StringType(), prime_award_project_description=T.StringType(),
    current_total_value_of_award=T.StringType(), total_obligated_amount=T.StringType(),
    period_of_performance_current_end_date=T.StringType(), period_of_performance_end_date=T.StringType(),
    recipient_name=T.StringType(), awarding_agency_name=T.StringType(),
)
FOREST = _struct(
    tree_id=T.IntegerType(), node_id=T.IntegerType(), is_leaf=T.BooleanType(), feature=T.IntegerType(),
    split=T.DoubleType(), left=T.IntegerType(), right=T.IntegerType(), depth=T.IntegerType(),
    n_samples=T.LongType(), path_len=T.DoubleType(),
)
