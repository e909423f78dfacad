import random

import pytest

from sparquill.streaming import tail


def drained(spark, tmp_path, size=tail.PART_BYTES):
    """Runs the stream to the end of what is there and returns the lines of all batches."""
    out = tail.growing_lines(spark, str(tmp_path / "logs"), partition_bytes=size)
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted((r["path"].rsplit("/", 1)[1], r["at"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def append(tmp_path, name, data):
    (tmp_path / "logs").mkdir(exist_ok=True)
    with open(tmp_path / "logs" / name, "ab") as f:
        f.write(data)


def test_halves_of_a_line_yield_it_once_also_after_a_restart(spark, tmp_path):
    append(tmp_path, "a.log", b"first\nsec")
    append(tmp_path, "b.log", b"no end yet")
    append(tmp_path, "c.txt", b"not asked for\n")
    assert drained(spark, tmp_path) == [("a.log", 0, "first")]
    append(tmp_path, "a.log", b"ond\r\n\nlast")
    append(tmp_path, "b.log", b"\n\xff\xfe bad\n")
    want = [("a.log", 0, "first"), ("a.log", 6, "second"), ("a.log", 14, ""), ("b.log", 0, "no end yet"), ("b.log", 11, "�� bad")]
    assert drained(spark, tmp_path) == want
    assert drained(spark, tmp_path) == want  # nothing new
    append(tmp_path, "a.log", b"\n")
    assert drained(spark, tmp_path) == sorted([*want, ("a.log", 15, "last")])


def test_a_shorter_file_is_read_anew(spark, tmp_path):
    append(tmp_path, "a.log", b"one\ntwo\nthree\n")
    drained(spark, tmp_path)
    (tmp_path / "logs" / "a.log").write_bytes(b"new\n")
    assert drained(spark, tmp_path)[-4:] == [("a.log", 0, "new"), ("a.log", 0, "one"), ("a.log", 4, "two"), ("a.log", 8, "three")]


def test_a_file_in_many_parts_gives_each_line_once(spark, tmp_path):
    rng = random.Random(5)
    rows = ["x" * rng.choice([0, 1, 7, 90, 400]) + str(i) for i in range(500)] + ["y" * 5000]
    append(tmp_path, "a.log", "".join(r + "\n" for r in rows).encode())
    assert [v for _, _, v in drained(spark, tmp_path, 333)] == rows


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1000])
@pytest.mark.parametrize("cut", [1, 2, 5, 9, 64])
def test_lines_of_ranges_are_those_of_the_file(tmp_path, block, cut):
    rng = random.Random(block * 100 + cut)
    data = b"".join(b"z" * rng.choice([0, 1, 2, 30]) + b"\n" for _ in range(40)) + b"open"
    path = tmp_path / "a.log"
    path.write_bytes(data)
    end = tail.last_end(str(path), len(data), block)
    assert data[:end].endswith(b"\n") and data[end:] == b"open"
    found = [x for a in range(0, end, cut) for x in tail.lines(str(path), a, min(end, a + cut), block)]
    want, at = [], 0
    for line in data[:end].split(b"\n")[:-1]:
        want.append((at, line))
        at += len(line) + 1
    assert found == want
