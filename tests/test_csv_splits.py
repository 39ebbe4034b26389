"""Records found over the splits of one CSV file, against Spark's multiLine reader."""

import random

import pytest

from possum.sources import csv_splits
from possum.sources.csv import read_extract


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def random_file(path, escape, seed, header=True):
    r = random.Random(seed)
    parts = ["a", "b,", "\n", "é", " ", "\\\\" if escape == "\\" else "\\", '\\"' if escape == "\\" else '""', "long text "]

    def field():
        if (k := r.random()) < 0.4:
            return str(r.randint(0, 999)) if k < 0.3 else ""
        return '"' + "".join(r.choice(parts) for _ in range(r.randint(0, 8))) + '"'

    lines = ['id,"na\nme",price,quantity'] if header else []
    for i in range(200):
        lines.append(",".join([str(i)] + [field() for _ in range(3 if r.random() < 0.9 else r.choice([1, 2, 4]))]))
        if r.random() < 0.05:
            lines.append("")
    lines.append('200,"one field' + "\n of many lines" * 60 + '",1,2')  # over many splits
    path.write_bytes(("\n".join(lines) + "\n").encode())


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("escape", ["\\", '"'])
@pytest.mark.parametrize("header", [True, False])
def test_equal_to_the_multi_line_reader(spark, tmp_path, small_splits, escape, header):
    path = tmp_path / "one.csv"
    random_file(path, escape, len(escape) + header, header)
    assert spark.read.text(str(path)).select("_metadata.file_block_start").distinct().count() > 30
    want = read_extract(spark, str(path), "products", escape=escape, header=header, line_breaks="whole")
    assert rows(read_extract(spark, str(path), "products", escape=escape, header=header)) == rows(want)


def test_folder_of_files_each_with_a_header(spark, tmp_path, small_splits):
    for i in range(3):
        random_file(tmp_path / f"{i}.csv", "\\", 10 + i)
    (tmp_path / "empty.csv").write_text("")
    want = read_extract(spark, str(tmp_path), "products", line_breaks="whole")
    assert rows(read_extract(spark, str(tmp_path), "products")) == rows(want)


def test_line_ends_of_windows(spark, tmp_path, small_splits):
    (tmp_path / "w.csv").write_bytes(b'id,name,price,quantity\r\n1,"two\r\nlines",$1.00,3\r\n2,plain,$2.00,4\r\n')
    got = read_extract(spark, str(tmp_path / "w.csv"), "products").orderBy("id").collect()
    assert [(r["id"], r["name"], r["quantity"]) for r in got] == [("1", "two\nlines", "3"), ("2", "plain", "4")]


def test_a_quote_that_never_closes_is_an_error(spark, tmp_path, small_splits):
    (tmp_path / "open.csv").write_text("id,name,price,quantity\n" + '1,"open\n' + "2,plain,3,4\n" * 2000)
    with pytest.raises(ValueError, match="doesn't end within"):
        read_extract(spark, str(tmp_path / "open.csv"), "products")


def test_patterns():
    import re

    for escape in ("\\", '"'):
        out, inside = (re.compile(p.replace(r"\z", r"\Z")) for p in csv_splits.quote_patterns(",", '"', escape))
        pair = escape + '"'
        for line, a, b in [("", 1, 0), ("a,b", 1, 0), ('"a","b"', 1, 1), ('a"b', 1, 1), ('"a', 0, 1), (f'"a{pair}', 0, 1), (f'"a{pair}"', 1, 1),
                           ('a",b', 1, 1), ('a","b', 0, 0), (f"x{pair}", 1, 0), ('","', 1, 0), ('"a"b"c,d', 1, 1)]:
            assert (bool(out.match(line)), bool(inside.match(line))) == (bool(a), bool(b)), (escape, line)
