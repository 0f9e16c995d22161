"""CSV with line breaks inside quotes: many tasks on one file, against Python's reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F
from tabkit.sources import files, quoted


def written(rows, ends="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=ends).writerows(rows)
    return out.getvalue()


def texts(rnd, n):
    parts = ["a", "b,c", 'say "x"', "line\nbreak", "\n", '"', "", "é", "long " * 30, '",\n"', "x,\n\ny", "'"]
    return [["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 4))) or "v", str(i), rnd.choice(parts) or "w"] for i in range(n)]


def found(spark, path, size, **options):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = files.read_csv(spark, str(path), schema="t string, i int, u string", multi_line=True, missing=(), **options)
        rows = sorted((r["i"], r["t"], r["u"]) for r in df.collect())
        tasks = quoted._lines(spark, str(path), "UTF-8").select(F.spark_partition_id()).distinct().count()
        return rows, tasks
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [40, 333, 10**7])
@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_a_single_file_is_read_by_several_tasks(spark, tmp_path, size, ends):
    rows = texts(random.Random(size), 120)
    (tmp_path / "f.csv").write_bytes(written([["t", "i", "u"], *rows], ends).encode())
    got, tasks = found(spark, tmp_path / "f.csv", size)
    assert got == sorted((int(i), t, u) for t, i, u in rows)
    assert tasks > 1 or size > 10**6


def test_fields_longer_than_blocks_and_several_files(spark, tmp_path):
    rows = [["q\n" * 400, "1", "x"], ["y", "2", "one\n" * 90 + '"'], ["z", "3", "end"]]
    for name, part in (("a.csv", rows), ("b.csv", [[t, str(int(i) + 10), u] for t, i, u in rows]), ("c.csv", [])):
        (tmp_path / name).write_text(written([["t", "i", "u"], *part]))
    got, _ = found(spark, tmp_path, 64)
    expected = [(int(i) + k, t, u) for k in (0, 10) for t, i, u in rows]
    assert got == sorted(expected)


def test_quotes_inside_fields_do_not_open_them(spark, tmp_path):
    (tmp_path / "q.csv").write_text('t,i,u\n5" disk,1,a\n"b\nc",2,d "e" f\nno end,3,"open')
    got, _ = found(spark, tmp_path / "q.csv", 9, mode="PERMISSIVE")
    assert [r[:2] for r in got] == [(1, '5" disk'), (2, "b\nc"), (3, "no end")] and got[1][2] == 'd "e" f'


def test_wrong_lengths_fail_and_other_encodings_are_read(spark, tmp_path):
    (tmp_path / "w.csv").write_text('t,i\n"a\nb",1,9\n')
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "w.csv")).collect()
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "w.csv"), mode="PERMISSIVE").collect()] == [("a\nb", 1)]
    (tmp_path / "l.csv").write_bytes('t,i\n"caf\xe9\nau lait",1\n'.encode("latin1"))
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "l.csv")).collect()] == [("café\nau lait", 1)]


def test_states_of_lines():
    assert quoted.after('a,"b', False) and not quoted.after('c",d', True) and quoted.after('c"",d', True)
    assert not quoted.after('x"y', False) and quoted.after("plain", True) and not quoted.after("", False)
    assert not quoted.after('"",""', False) and quoted.after('"a","', False)
