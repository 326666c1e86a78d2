from gridloom.operators import transforms as X
from gridloom.streaming import read_stream


def test_documents_arrive(spark, tmp_path):
    folder, like = tmp_path / "in", tmp_path / "like.csv"
    folder.mkdir()
    like.write_text("a,b\n0,x\n")
    (folder / "1.csv").write_text("a,b\n1,x\n2,y\n")
    rows = read_stream(spark, str(folder), str(like), "csv", assoc=True).transform(X.cast({"a": "int"}))
    assert rows.isStreaming
    query = rows.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    (folder / "2.csv").write_text("a,b\n3,z\n")
    query.processAllAvailable()
    query.stop()
    assert sorted((r["a"], r["b"]) for r in spark.table("arrived").collect()) == [(1, "x"), (2, "y"), (3, "z")]
