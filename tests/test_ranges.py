"""Files by byte ranges: line numbers, bounded heads, and code fences over many nodes."""

import random
import re

import pytest

from gleaner.operators import scan
from gleaner.sources import memory_file, transcripts


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def lines_of(text):
    found = re.split("\r\n|\r|\n", text)
    return found[:-1] if found[-1] == "" else found


def test_lines_of_many_ranges(spark, tmp_path, small_ranges):
    r = random.Random(3)
    expected = {}
    for name, n in (("a", 900), ("b c", 3), ("empty", 0), ("long", 40)):
        ends = ["\n", "\r\n", "\r"] if name != "long" else ["\n"]
        body = "".join("é" * r.choice([0, 1, 7, 60] if name != "long" else [900]) + f"x{i}" + r.choice(ends) for i in range(n)) + ("tail" if n else "")
        (tmp_path / f"{name}.txt").write_bytes(body.encode())
        expected[name] = lines_of(body)
    frame = transcripts.read_lines(spark, str(tmp_path))
    assert frame.rdd.getNumPartitions() > 1 and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = {}
    for row in frame.collect():
        got.setdefault(row.path.rsplit("/", 1)[1].replace("%20", " ")[:-4], {})[row.line_no] = row.line
    for name, lines in expected.items():
        assert got.get(name, {}) == dict(enumerate(lines, 1)), name


def test_no_more_than_the_head_is_read(spark, tmp_path):
    (tmp_path / "early one.jsonl").write_text("x" * 100 + "/proj/a" + "y" * 200_000)
    (tmp_path / "late.jsonl").write_text("x" * 70_000 + "/proj/a")
    (tmp_path / "other.txt").write_text("/proj/a")
    found = transcripts.discover(spark, [str(tmp_path)], "/proj/a").collect()
    assert [r.path.rsplit("/", 1)[1] for r in found] == ["early%20one.jsonl"] and found[0].length == 200_107
    files = transcripts._listed(spark, [str(tmp_path)])
    assert {len(r["head"]) for r in transcripts.heads(files, 50).collect()} == {7, 50}


def plain(text):
    """(number, section) of claim lines by a plain walk."""
    out, fence, section = [], "", None
    for number, raw in enumerate(re.split("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", text), 1):
        bare, mark = raw.strip(), re.match(r" {0,3}(`{3,}|~{3,})", raw)
        if fence:
            fence = "" if bare and set(bare) == {fence} else fence
        elif mark:
            fence = mark[1][0]
        elif re.match(r" {0,3}#{1,6}(\s|$)", raw):
            section = bare.lstrip("#").strip() or None
        elif bare:
            out.append((number, section))
    return out


@pytest.mark.parametrize("node, fan", [(3, 2), (50, 64)])
def test_fences_over_nodes(spark, tmp_path, monkeypatch, small_ranges, node, fan):
    monkeypatch.setattr(memory_file, "NODE", node)
    monkeypatch.setattr(scan, "FAN", fan)
    r = random.Random(node)
    kinds = ["claim {}", "claim {}", "claim {}", "```", "~~~", "~", "`", "```py", "~~~~", "# head {}", "##", "", "  ", "a b {}", "x\x0cy {}"]
    texts = {f"f{k}": "\n".join(r.choice(kinds).format(i) for i in range(n)) for k, n in enumerate((0, 1, 7, 260))}
    frame = spark.createDataFrame(list(texts.items()), "path string, text string")
    expected = {(p, *x) for p, t in texts.items() for x in plain(t)}
    assert {(x.path, x.number, x.section) for x in memory_file.memory_lines(frame).collect()} == expected
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got = memory_file.read_memory_lines(spark, str(tmp_path)).collect()
    assert {(x.path.rsplit("/", 1)[1], x.number, x.section) for x in got} == expected
