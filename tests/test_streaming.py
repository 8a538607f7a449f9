from __future__ import annotations

from graphaxis.streaming.rescan import stream_observations


def test_files_become_observations(spark, tmp_path):
    folder = tmp_path / "src"
    folder.mkdir()
    (folder / "a.ts").write_text("process.env.A_KEY;")
    (folder / "b.min.js").write_text("process.env.NOT_READ;")
    query = stream_observations(spark, str(folder)).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        (folder / "c.js").write_text("process.env.C_KEY;")
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r.keys[0] for r in spark.table("seen").where("nth >= 0").collect()) == ["A_KEY", "C_KEY"]
