from laneflow.streaming.late import DROPS, LateRows


def test_a_batch_run_again_counts_once(spark, tmp_path):
    told = [("q", 7, 3), ("q", 7, 3), ("q", 8, 2), ("r", 7, 1)]
    path = str(tmp_path / "late")
    spark.createDataFrame(told, DROPS).write.json(path)
    out = {tuple(r) for r in LateRows(spark, path).dropped().collect()}
    assert out == {("q", 2, 5), ("r", 1, 1)}
