"""The roll-up as a stream against the roll-up of all rows."""

import datetime
import random

import pytest

from awardsift.operators.aggregates import rollup_awards
from awardsift.streaming import rollup

SCHEMA = "kind string, piid string, description string, value double, end_date timestamp, vendor string, agency string, path string, row_no long, at timestamp"
KEYS, ORDER = ["kind", "piid"], ["path", "row_no"]
DAY = datetime.datetime(2024, 1, 1)


def rows(seed, n):
    draw = random.Random(seed)
    out = []
    for k in range(n):
        text = [draw.choice([None, f"t{k}", f"u{k % 7}"]) for _ in range(3)]
        out.append((draw.choice(["grants", "contracts", None]), draw.choice([None, "a", "b", "c", "d"]), text[0],
                    draw.choice([None, float("nan"), -1.5, float(k)]), draw.choice([None, DAY + datetime.timedelta(days=k % 50)]), text[1], text[2],
                    draw.choice([None, "x", "y"]), k, DAY + datetime.timedelta(hours=k)))
    draw.shuffle(out)
    return out


def as_text(df):
    return sorted(str(tuple(r[c] for c in ("kind", "piid", "description", "value", "end_date", "vendor", "agency"))) for r in df.collect())


@pytest.fixture()
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def land(spark, data, path):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, **more):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "landed"))
    query = rollup.rollup_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), KEYS, ORDER, **more)
    query.awaitTermination()
    return query


@pytest.mark.parametrize("seed, cuts", [(1, [120]), (2, [1, 2, 60, 120]), (3, [50, 51, 90, 119, 120])])
def test_any_split(spark, tmp_path, few_partitions, seed, cuts):
    """Any split into batches, with a new start from the checkpoint before the last one."""
    data = rows(seed, 120)
    for start, end in zip([0, *cuts[:-1]], cuts):
        land(spark, data[start:end], str(tmp_path / "landed"))
        if end in cuts[-2:]:
            run(spark, tmp_path)
    expected = rollup_awards(spark.createDataFrame(data, SCHEMA), KEYS, ORDER)
    assert as_text(rollup.current_awards(spark, str(tmp_path / "out"), KEYS, ORDER)) == as_text(expected)


def test_merging_is_the_aggregates_order():
    assert rollup._greater(float("nan"), 1.0) != rollup._greater(float("nan"), 1.0) and rollup._greater(1.0, None) == 1.0 and rollup._greater(None, None) is None
    assert rollup._rank([None, 5]) < rollup._rank(["a", 1]) < rollup._rank(["a", 2]) < rollup._rank(["b", None])


def test_watermark_closes_awards(spark, tmp_path, few_partitions):
    """Awards without rows for a day are closed; a late row is dropped and counted; one in time opens an award anew."""
    def award(piid, hour, text, value):
        return ("grants", piid, text, value, None, None, None, "x", hour, DAY + datetime.timedelta(hours=hour))

    batches = [
        [award("a", 0, "first", 1.0), award("b", 1, "b", 1.0)],
        [award("b", 100, "b later", 5.0)],  # the watermark moves to hour 98; "a" is idle
        [award("b", 101, "b again", 4.0)],
        [award("a", 100, "a again", 9.0), award("a", 2, "too late", 99.0)],
    ]
    for data in batches:
        land(spark, data, str(tmp_path / "landed"))
        query = run(spark, tmp_path, watermark=("at", "2 hours"), idle=datetime.timedelta(days=1))
    found = {r.piid: (r.description, r.value) for r in rollup.current_awards(spark, str(tmp_path / "out"), KEYS, ORDER).collect()}
    assert found == {"a": ("first", 9.0), "b": ("b", 5.0)}
    openings = spark.read.parquet(str(tmp_path / "out")).select("piid", "opening").distinct().groupBy("piid").count().collect()
    assert {r.piid: r["count"] for r in openings}["a"] == 2
    dropped = sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)
    assert dropped == 1
    with pytest.raises(ValueError):
        rollup.rollup_changes(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "landed")), KEYS, ORDER, watermark=("at", "1 hour"))


def test_kept_for_good_without_python(spark, tmp_path):
    """Without a watermark no row passes a Python worker: the state is an aggregation's."""
    land(spark, rows(4, 10), str(tmp_path / "landed"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "landed"))
    plan = rollup.rollup_changes(stream, KEYS, ORDER)._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "TransformWithState" not in plan
