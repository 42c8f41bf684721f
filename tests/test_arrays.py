"""Arrays of JSON cut by ranges of bytes, against the plain parser."""

import gzip
import json
import random
import re
from contextlib import contextmanager

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from strata.sources import landing
from strata.sources.arrays import _pieces, read_array_elements

BITS = ['"', "\\", "{", "}", "[", "]", ",", ":", "a", "é", "\n", " ", '\\"', "}{", " ", "😀"]


@contextmanager
def ranges_of(spark, size):
    """Ranges of so many bytes, however small the files are."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, str(size))
    try:
        yield
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def objects(seed, n):
    rng = random.Random(seed)
    for k in range(n):
        row = {"id": k, "t": "".join(rng.choices(BITS, k=rng.choice([0, 5, 60, 400])))}
        if k % 5 == 0:
            row["deep"] = {"x": [{"y": "}]"}, [], [[{}]]], "z": {}}
        yield row


@pytest.mark.parametrize("size, indent", [(150, None), (999, 2)])
def test_ranges_of_any_size_give_the_same_elements(spark, tmp_path, size, indent):
    rows = list(objects(size, 90))
    for day, some in ((1, rows[:60]), (2, rows[60:])):
        (tmp_path / f"day={day}").mkdir()
        (tmp_path / f"day={day}" / "a.json").write_text(json.dumps(some, indent=indent, ensure_ascii=day == 1))
    with ranges_of(spark, size):
        read = spark.read.option("lineSep", "}").text(str(tmp_path))
        assert read.rdd.getNumPartitions() > 4
        got = [(r.day, json.loads(r.body)) for r in read_array_elements(spark, str(tmp_path)).collect()]
    assert sorted(got, key=lambda r: r[1]["id"]) == [(1 if k < 60 else 2, row) for k, row in enumerate(rows)]


def test_one_element_over_many_ranges(spark, tmp_path):
    rows = [{"id": 1}, {"id": 2, "t": '"}{' * 800, "l": [{"k": i} for i in range(100)]}, {"id": 3}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    with ranges_of(spark, 500):
        got = [json.loads(r.body) for r in read_array_elements(spark, str(tmp_path)).collect()]
    assert sorted(got, key=lambda r: r["id"]) == rows


CASES = [
    ("", []),
    (" \n", []),
    ("[]", []),
    (" [ \n ] \n", []),
    ('[{"id":1}]', ['{"id":1}']),
    ('﻿[ {"id":1} ,\r\n{"id":2}\t]\n', ['{"id":1}', '{"id":2}']),
    ('{"a":{"id":1},"b":{}}', ['{"a":{"id":1},"b":{}}']),
    ('{"a":{"id":1}}\n', ['{"a":{"id":1}}\n']),
    ('[{"id":1},{"id":2', ['{"id":1}', '{"id":2']),
    ('[{"id":1},{"id":2}', ['{"id":1}', '{"id":2']),
    ('[{"id":1},{"t":"}', ['{"id":1}', '{"t":"']),
    ('[{"id":1}, 7, "x"]', ['{"id":1}', '7, "x"]']),
    ("[1,2]", ["1,2]"]),
    ('[{"id":1}] more', ['{"id":1}', "] more"]),
    ('[[{"id":1}],{"id":2}]', ['[{"id":1}],{"id":2}']),
]


@pytest.mark.parametrize("size", [3, 1 << 20])
def test_borders(spark, tmp_path, size):
    for k, (text, _) in enumerate(CASES):
        (tmp_path / f"case={k}").mkdir()
        (tmp_path / f"case={k}" / "a.json").write_text(text)
    with ranges_of(spark, size):
        got = sorted(map(tuple, read_array_elements(spark, str(tmp_path)).select("case", "body").collect()))
    assert got == sorted((k, body) for k, (_, want) in enumerate(CASES) for body in want)


def test_compressed_files(spark, tmp_path):
    rows = list(objects(1, 50))
    (tmp_path / "a.json.gz").write_bytes(gzip.compress(json.dumps(rows).encode()))
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(b'{"id":99}'))
    got = [json.loads(r.body) for r in read_array_elements(spark, str(tmp_path)).collect()]
    assert sorted(got, key=lambda r: r["id"]) == [*rows, {"id": 99}]


def test_landing_of_arrays(spark, tmp_path):
    (tmp_path / "day=1").mkdir()
    (tmp_path / "day=1" / "a.json").write_text('[{"id":1,"day":9},{"id":"x"},{"id":3},{"id":4')
    path, schema = str(tmp_path), "id int, day int"

    def read(**options):
        return landing.read_landing(spark, path, "json", schema, lines=False, split=True, **options)

    with ranges_of(spark, 16):
        good, bad = landing.split_corrupt(read(on_bad="quarantine"))
        assert sorted(map(tuple, good.select("id", "day").collect())) == [(1, 1), (3, 1)]
        assert sorted(r[landing.CORRUPT] for r in bad.collect()) == ['{"id":"x"}', '{"id":4']
        skipped = Observation()
        assert sorted(r.id for r in read(on_bad="skip", skipped=skipped).collect()) == [1, 3]
        assert skipped.get == {"bad_records": 2}
        with pytest.raises(Exception, match="bad record"):
            read().collect()
        raw = landing.read_landing(spark, path, "json", lines=False, raw=True, split=True)
        assert raw.count() == 4
    with pytest.raises(ValueError, match="splitting"):
        landing.read_landing(spark, path, "json", schema, split=True)


def test_states_are_found_without_moving_text(spark, tmp_path):
    """The text itself stays out of the shuffle where only states of ranges are wanted."""
    (tmp_path / "a.json").write_text(json.dumps(list(objects(1, 20))))
    states = _pieces(spark, [str(tmp_path)]).groupBy("_file", "_odd", "_depth0", "_depth1").agg(F.max("_opening"), F.sum("_octets"))
    plan = states._jdf.queryExecution().optimizedPlan().toString()
    shuffled = plan[plan.rindex("Window [") :].splitlines()[1]
    assert "Project [" in shuffled and not re.search(r"(\[|, )value#\d+[,\]]", shuffled)
    assert states.agg(F.max("max(_opening)")).first()[0]
