import types

import pytest

from cohortveil import session


def fake_session(master, named=None):
    context = types.SimpleNamespace(master=master, held=None)
    context.getCheckpointDir = lambda: context.held
    context.setCheckpointDir = lambda d: setattr(context, "held", d)
    return types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda k, d=None: named))


def test_cluster_without_shared_folder_raises():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            session.shared_folder(fake_session(master))


def test_named_folder_is_used_and_local_falls_back():
    assert session.shared_folder(fake_session("yarn", "hdfs://shared/x")) == "hdfs://shared/x"
    assert "cohortveil-" in session.shared_folder(fake_session("local[4]"))


def test_written_tables_are_removed(spark):
    mark = session.mark_cuts(spark)
    kept = session.cut(spark.range(5))
    assert kept.count() == 5
    assert session.drop_cuts(spark, mark) == 1
    with pytest.raises(Exception):
        kept.count()


def test_python_workers_get_small_batches(spark):
    """A batch held 10,000 whole texts, however long."""
    from pyspark.sql import functions as F
    import pyarrow as pa

    import corpus_pipeline

    for name in session.BATCH_SETTINGS:
        spark.conf.unset(name)
    name, stage = corpus_pipeline.STAGES[1]
    docs = spark.createDataFrame([(1, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    stage(spark, docs, "")
    assert all(spark.conf.get(k) == v for k, v in session.BATCH_SETTINGS.items())

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    rows = spark.range(0, 5000, 1, 1).withColumn("text", F.when(F.col("id") < 100, F.repeat(F.lit("x"), 1_000_000)).otherwise("y"))
    held = rows.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in held) == 5000 and max(r.n for r in held) <= 1000
    assert max(r["size"] for r in held) <= 10_000_000
