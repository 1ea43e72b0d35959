import pytest
from conftest import rows_of

from strata import session


class Session:
    """Just enough of a session to ask for its folder."""

    def __init__(self, master, folder=None):
        self.conf = {"spark.sql.warehouse.dir": "/house/"} | ({"spark.checkpoint.dir": folder} if folder else {})
        self.sparkContext = self
        self.master, self.applicationId = master, f"app-{master}"

    def getCheckpointDir(self):
        return None


def test_the_cluster_names_the_folder():
    assert session.shared_folder(Session("yarn", "hdfs://nn/shared")) == "hdfs://nn/shared"
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            session.shared_folder(Session(master))


def test_a_local_session_gets_one_folder_in_its_warehouse():
    local = Session("local[2]")
    assert session.shared_folder(local) == "/house/_work/app-local[2]"
    assert session.fresh_path(local, "x") != session.fresh_path(local, "x")


def test_written_rows_are_the_same_rows_of_known_size(spark):
    df = spark.range(10).selectExpr("id", "CASE WHEN id > 3 THEN 'x' END AS s")
    table = session.written(df, "check")
    assert rows_of(table) == rows_of(df) and table.columns == df.columns
    assert "FileScan parquet" in table._jdf.queryExecution().executedPlan().toString()
    assert session.shared_folder(spark) in table.inputFiles()[0]


def test_work_folders_are_removed_on_request(spark):
    table = session.written(spark.range(3), "to-clear")
    assert session.clear_work(spark, keep_hours=1) == 0 and table.count() == 3
