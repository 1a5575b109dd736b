import os
from types import SimpleNamespace

import pyarrow as pa
import pytest

from trackloom.llm import common


def test_stored_and_released(spark):
    df = common.stored(spark.range(5), "five")
    assert df.count() == 5 and df.dtypes == spark.range(5).dtypes
    folder = common.scratch_dir(spark).removeprefix("file://")
    assert any(n.startswith("five-") for n in os.listdir(folder))
    common.release(spark)
    assert not os.path.exists(folder)


def test_shared_folder_comes_from_the_session():
    context = SimpleNamespace(getConf=lambda: {}, applicationId="app")
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: {"spark.checkpoint.dir": "viewfs://shared/x"}.get(k, d)), sparkContext=context)
    assert common.scratch_dir(session) == "viewfs://shared/x/scratch-app"


def test_memo_keeps_two_generations():
    m = common.Memo(2)
    for i in range(5):
        m.put(i, i + 1)
    assert len(m.new) + len(m.old) <= 4 and m.old_value(3) == 4 and m.old_value(0) is None


def test_words(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("A-b Ä,1x\x7f_y",), (None,), ("",)], "t string").select(common.words(F.col("t")).alias("w")).collect()
    assert [r.w for r in got] == [["a", "b", "Ä", "1x", "y"], [], []]


def test_a_cluster_must_name_the_shared_folder():
    context = SimpleNamespace(getConf=lambda: {}, applicationId="app", master="spark://host:7077")
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_dir(session)


def test_batches_are_cut_and_joined():
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(range(a, b))], names=["x"])
    cut = list(common.sliced(iter([batch(0, 7), batch(7, 7), batch(7, 9)]), 3))
    assert [b.num_rows for b in cut] == [3, 3, 1, 2] and [v for b in cut for v in b.column(0).to_pylist()] == list(range(9))
    joined = list(common.gathered(iter([batch(0, 2), batch(2, 5), batch(5, 6)]), 4))
    assert [b.num_rows for b in joined] == [5, 1] and [v for b in joined for v in b.column(0).to_pylist()] == list(range(6))
