"""Logical files, versions, byte ranges and canonical JSON against serial computation."""

import hashlib
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gradeflow.functions.canonical import canonical_json
from gradeflow.sources import ordered, ranges, records


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def serial_root(lines, width):
    level = [sha("".join(x + "\n" for x in lines[i : i + width])) for i in range(0, len(lines), width)]
    while len(level) > 1:
        parts = [level[i : i + width] for i in range(0, len(level), width)]
        level = [sha("".join(p)) if len(p) > 1 else p[0] for p in parts]
    return level[0]


@pytest.mark.parametrize("width", [2, 3, 10, 1024])
def test_trees_of_groups(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice([None, "a", "b", "b", "b"]), i, f"line {rng.random()} ü") for i in range(257)]
    df = spark.createDataFrame(rows, "g string, i long, x string").repartition(6)
    got = {r["g"]: (r["digest"], r["lines"]) for r in ordered.tree_digests(df, ["g"], ["i"], "x", width).collect()}
    groups = {g: [x for h, _, x in rows if h == g] for g in {r[0] for r in rows}}
    assert got == {g: (serial_root(x, width), len(x)) for g, x in groups.items()}
    assert ordered.tree_digests(df, [], ["i"], "x", width).first()["digest"] == serial_root([x for _, _, x in rows], width)
    assert ordered.tree_digests(df.filter("false"), ["g"], ["i"], "x", width).count() == 0


def whole(files):
    """Lines as files put together by name hold them."""
    return [r["value"] for r in files.read().withColumn("n", F.monotonically_increasing_id()).orderBy("part", "n").collect()]


def test_versions_and_a_crash_between_steps(spark, tmp_path):
    rows = spark.range(3000).select("id", F.concat(F.lit("l"), "id").alias("value")).repartition(7)
    files = ordered.Versions(spark, str(tmp_path / "file"))
    assert files.current() is None
    one = files.replace(rows, ["id"])
    expected = [f"l{i}" for i in range(3000)]
    assert whole(files) == expected and one["lines"] == 3000 and one["digest"] == serial_root(expected, 1024) == files.current()["digest"]
    assert files.read().select("part").distinct().count() > 4  # no task had all lines
    two = files.write(rows.filter("id < 10"), ["id"])  # and then the driver dies
    again = ordered.Versions(spark, str(tmp_path / "file"))
    assert whole(again) == expected
    done = again.publish(two, after=1)
    assert done["number"] == 2 and whole(again) == expected[:10]
    with pytest.raises(ValueError, match="at 2, not at 1"):
        again.publish(one, after=1)
    assert len(again.tidy()) == 2 and whole(again) == expected[:10]
    empty = again.replace(rows.filter("false"), ["id"])
    assert empty["lines"] == 0 and empty["digest"] == sha("") and whole(again) == []


def test_atomic_records(spark, tmp_path):
    at = str(tmp_path / "records")
    rows = spark.createDataFrame([(2, "b\n"), (1, None)], "id long, t string")
    records.write_atomically(rows, at, ["id"])
    records.write_atomically(rows.withColumn("t", F.lit("new")), at, ["id"])
    assert [tuple(r) for r in records.read_current(spark, at, "id long, t string").orderBy("id").collect()] == [(1, "new"), (2, "new")]
    done = records.write_canonical(rows, str(tmp_path / "canonical"), ["id"])
    assert done["digest"] == serial_root(['{"id":1,"t":null}', '{"id":2,"t":"b\\n"}'], 1024)
    with pytest.raises(ValueError, match="already exists"):
        records.write_canonical(rows, str(tmp_path / "canonical"), ["id"])
    with pytest.raises(ValueError, match="1 records"):
        records.compile_lines(spark.createDataFrame([(3, 1)], "id long, o long"), rows, "id", "o", str(tmp_path / "short"))


def test_digests_of_files_by_ranges(spark, tmp_path):
    data = {"a": b"", "b": b"x" * 99, "d/c": bytes(range(256)) * 41, ".hidden": b"no"}
    for name, content in data.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    for step in (100, 64 << 20):
        got = {r["path"][len(str(tmp_path)) + 1 :]: (r["size"], r["digest"]) for r in ranges.file_digests(spark, str(tmp_path), step).collect()}
        parts = lambda x: [hashlib.sha256(x[i : i + step]).hexdigest() for i in range(0, max(len(x), 1), step)]  # noqa: E731, B023
        assert got == {k: (len(x), parts(x)[0] if len(parts(x)) == 1 else sha("".join(parts(x)))) for k, x in data.items() if k != ".hidden"}
    assert ranges.file_digests(spark, f"file:{tmp_path}/b").first()["digest"] == hashlib.sha256(data["b"]).hexdigest()


def test_a_file_of_three_gigabytes(spark, tmp_path):
    size = 3 * (1 << 30) + 5
    with open(tmp_path / "large", "wb") as file:
        file.truncate(size)
        file.seek(size - 1)
        file.write(b"!")
    row = ranges.file_digests(spark, str(tmp_path)).first()
    zeros, last = hashlib.sha256(bytes(ranges.RANGE)).hexdigest(), hashlib.sha256(b"\0\0\0\0!").hexdigest()
    assert row["size"] == size and row["digest"] == sha(zeros * 48 + last)


def test_one_file_a_record(spark, tmp_path):
    ranges.write_files(spark.createDataFrame([(f"x/{i}/r.json", f"text {i}") for i in range(20)], "name string, text string").repartition(4), str(tmp_path / "out"))
    assert {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()} == {f"x/{i}/r.json": f"text {i}" for i in range(20)}
    assert {r["folder"]: r["files"] for r in records.file_counts(spark, str(tmp_path / "out")).collect()} == {f"x/{i}": 1 for i in range(20)}


def test_files_of_an_interrupted_run(spark, tmp_path):
    body = {"id": 1, "t": "ü"}
    good = body | {"record_checksum": sha(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False))}
    texts = {"tmpabc": "{}", "a.json": json.dumps(good), "b.json": json.dumps(good)[:-4], "c.json": json.dumps(good | {"t": "u"}), "d.json": "", "e.txt": "{", "tmp.json": json.dumps(good), "f.json": json.dumps(body)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    expected = {"tmpabc": "temporary_file", "tmp.json": "temporary_file", "b.json": "invalid_json", "d.json": "invalid_json", "c.json": "checksum_mismatch", "f.json": "checksum_mismatch"}
    for confirmed in (False, True):
        got = records.delete_broken(spark, str(tmp_path), "id long, t string", confirmed)
        assert {r["path"].rsplit("/", 1)[1]: (r["reason"], r["removed"]) for r in got.collect()} == {k: (v, confirmed) for k, v in expected.items()}
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["a.json", "e.txt"]


def test_canonical_json_of_nested_maps_arrays_and_decimals(spark):
    kind = "a array<double>, b map<string,array<struct<y:double,x:string>>>, c decimal(20,0), d decimal(30,3), e map<int,float>, f struct<z:array<array<double>>,y:map<string,boolean>>, g array<struct<p:int,q:decimal(10,2)>>, h double"
    rows = [
        ([1.0, 0.1, 1e300, -0.0, 1e-7, float("inf"), None], {"ü": [(2.5, 'q"\n'), (None, None)], "A": [], "b": None}, Decimal(10**19), Decimal("1.500"), {10: 1.5, 9: None}, ([[1.0], [], None], {"k": True}), [(1, Decimal("2.25")), None], 1e16),
        (None,) * 8,
        ([], {}, Decimal(-3), Decimal("123456789012345678901234567.125"), {}, (None, None), [], 5e-324),
    ]
    df = spark.createDataFrame(rows, kind).coalesce(1)
    got = [r["j"] for r in df.select(canonical_json(df).alias("j")).collect()]
    plain = lambda d: None if d is None else int(d) if d == int(d) and d.as_tuple().exponent == 0 else float(d)

    def record(r):
        a, b, c, d, e, f, g, h = r
        b = b and {k: v and [{"y": y, "x": x} for y, x in v] if v is not None else None for k, v in b.items()}
        f = f and {"z": f[0], "y": f[1]}
        g = g and [x and {"p": x[0], "q": plain(x[1])} for x in g]
        return {"a": a, "b": b, "c": plain(c), "d": "DIGITS" if d and d > 10**20 else plain(d), "e": e and dict(e), "f": f, "g": g, "h": h}

    expected = [json.dumps(record(r), sort_keys=True, separators=(",", ":"), ensure_ascii=False).replace('"DIGITS"', "123456789012345678901234567.125") for r in rows]
    assert got == expected
    for bad in ("binary", "map<double,int>", "array<binary>", "interval day to second", "array<struct<a:double,b:date>>"):
        with pytest.raises(TypeError, match="no JSON text"):
            canonical_json(spark.createDataFrame([], f"x {bad}"))
