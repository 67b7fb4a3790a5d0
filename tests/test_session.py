from unittest.mock import MagicMock

import pytest

from rowsmith import session
from rowsmith.errors import RowsmithError


def fake(master, setting=None):
    spark = MagicMock()
    spark.sparkContext.getConf.return_value.get.return_value = setting
    spark.conf.get.return_value = None
    spark.sparkContext.getCheckpointDir.return_value = None
    spark.sparkContext.master = master
    return spark


def test_the_cluster_names_the_shared_folder():
    assert session.shared_folder(fake("yarn", "hdfs:///shared")) == "hdfs:///shared"
    with pytest.raises(RowsmithError):
        session.shared_folder(fake("spark://host:7077"))
    assert session.shared_folder(fake("local[8]"))


def test_cut_lineage_reads_the_written_copy(spark):
    df = session.cut_lineage(spark.range(100).repartition(4))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and df.count() == 100
    assert df.sparkSession.sparkContext.getCheckpointDir()


def test_executors_need_no_copy_of_the_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from rowsmith.operators.models import margins, neighbors

    (tmp_path / "f").write_bytes(cloudpickle.dumps((neighbors._nearest, margins.fourier_map, neighbors.Cuts)))
    code = "import pickle, sys; pickle.load(open('f', 'rb')); assert 'rowsmith' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=60, env={"PATH": ""})
