"""Transcripts that are kept many a file."""

import glob

from gleaner.sources import transcripts


def test_packed_transcripts_keep_their_lines(spark, tmp_path):
    # names, empty lines and tabs inside lines are kept; ranges of 700 bytes cut a transcript anywhere
    texts = {f"t {k}": [f"{k}\tline {i} " + "é" * (k % 50) if i % 3 else "" for i in range(1 + k % 9)] for k in range(120)}
    texts["long"] = [f"row {i}" for i in range(400)]
    rows = [(name, i, line) for name, lines in texts.items() for i, line in enumerate(lines)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        folder = str(tmp_path / "packed")
        transcripts.write_packed(spark.createDataFrame(rows, "path string, n int, line string"), folder, "n")
        found = transcripts.read_packed(spark, folder).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.path, r.line_no, r.line) for r in found) == sorted((p, i + 1, line) for p, i, line in rows)
    # a few files, not one a transcript
    assert len(glob.glob(f"{folder}/*.txt")) <= 4
