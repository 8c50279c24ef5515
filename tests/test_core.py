import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tablewright.model import RID, DataError, Finding
from tablewright.operators import actions as A
from tablewright.operators.checks import CHECKS, scan
from tablewright.operators.profile import Profile
from tablewright.plans.catalogue import ORACLES, QUERIES
from tablewright.plans.cleaner import Cleaner, replay
from tablewright.plans.planner import build_plan, refusal, review, risk_of
from tablewright.plans.service import Service
from tablewright.sources.readers import csv_text, load_bytes, read_any, records, sniff_delimiter
from tablewright.sources.writers import FORMATS, to_bytes, write_any
from tablewright.streaming.replay import replay_stream, start

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


def values(df, c):
    return [r[c] for r in df.collect()]


def test_counts():
    assert len(CHECKS) == 20 and len(A.ACTIONS) == 24


@pytest.mark.parametrize("name", ["sentinel_replace", "column_profile", "category_collisions", "unify_categories", "fill_interpolate", "fill_ffill", "outliers_mad_clip", "drop_duplicates_last", "cast_numeric", "mask_hash", "replay_recipe", "union_by_name_sources"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    rows = sorted(repr([r[c] for c in order]) for r in got.collect())
    assert rows == sorted(repr([dict(zip(want.columns, r))[c] for c in order]) for r in want.fetchall())


@pytest.mark.parametrize("name", ["near_dup", "drop_near_dup"])
def test_near_copies_as_in_sql(spark, tmp_path, name):
    """Letters that the engines' full mappings of case or classes of letters take otherwise."""
    odd = [chr(c) for c in range(0x80, 0x11000) if not 0xD800 <= c < 0xE000 and (chr(c).isalnum() or chr(c).upper() != chr(c))]
    texts = ["Gro\u00dfe Stra\u00dfe", "gro\u00dfe stra\u00dfe", "grosse strasse", "\u039f\u0394\u039f\u03a3", "\u03bf\u03b4\u03bf\u03c2", "\u03bf\u03b4\u03bf\u03c3", "\u0130x", "ix", "\ufb01n", "FIN", "", None]
    texts += ["".join(odd[k : k + 2]) for k in range(0, len(odd), 2)] + [f"{c} {k}" for k, c in enumerate("\u1c89\ua7cb\u0870\U00010570\u019b")]
    rows = [(9 * k, t, "en" if k % 3 else "de") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()) == sorted(con.sql(ORACLES[name]).fetchall())


def test_numbers_and_dates(spark):
    df = spark.createDataFrame([("$1,234",), ("(5)",), ("1,23",), (" 7 % ",), ("1e400",), ("nan",), (None,)], "x string")
    assert values(A.cast_numeric(df, ["x"])[0], "x") == [1234.0, -5.0, None, 7.0, None, None, None]
    d = spark.createDataFrame([("03/04/2024",), ("2024-01-31",), ("31 Jan 2024",), ("x",)], "d string")
    assert [str(x)[:10] for x in values(A.cast_datetime(d, ["d"], dayfirst=True)[0], "d")] == ["2024-04-03", "2024-01-31", "2024-01-31", "None"]
    assert str(values(A.cast_datetime(d, ["d"])[0], "d")[0])[:10] == "2024-03-04"


def test_text(spark):
    df = spark.createDataFrame([("o'neil-smith 3rd",)], "t string")
    assert values(A.normalize_case(df, ["t"], "title")[0], "t") == ["O'Neil-Smith 3Rd"]
    moji = spark.createDataFrame([("cafÃ©",), ("café",), ("Ã",), ("日本",), (None,)], "t string")
    assert values(A.fix_encoding(moji)[0], "t") == ["café", "café", "Ã", "日本", None]
    odd = spark.createDataFrame([(" a\t b　",)], "t string")
    assert values(A.strip_whitespace(odd)[0], "t") == ["a b"]
    part = spark.createDataFrame([("abc",), ("john@x.y",), ("abcdefgh",)], "t string")
    assert values(A.mask_pii(part, ["t"], "partial")[0], "t") == ["abbc", "jo***@x.y", "ab****gh"]


def test_fill_and_duplicates(spark):
    df = spark.createDataFrame([(1, None, None), (2, 2.0, "b"), (3, None, None), (4, 6.0, "a"), (5, None, "a")], "i long, x double, s string")
    fill = lambda **k: values(A.fill_missing(df, order="i", **k)[0].orderBy("i"), k["columns"][0])
    assert fill(columns=["x"], strategy="ffill") == [None, 2.0, 2.0, 6.0, 6.0]
    assert fill(columns=["x"], strategy="bfill") == [2.0, 2.0, 6.0, 6.0, None]
    assert fill(columns=["x"], strategy="interpolate") == [2.0, 2.0, 4.0, 6.0, 6.0]
    assert fill(columns=["s"], strategy="auto") == ["a", "b", "a", "a", "a"]
    assert fill(columns=["x"], strategy="median") == [4.0, 2.0, 4.0, 6.0, 4.0]
    twice = spark.createDataFrame([("A!", 1, 1), ("a", 2, 2), (None, 3, 3), (None, 4, 4)], "t string, n long, i long")
    assert sorted(values(A.drop_near_duplicate_rows(twice, ["t"], "last", order="i")[0], "i")) == [2, 4]
    assert sorted(values(A.drop_duplicate_rows(twice, ["t"], order="i")[0], "i")) == [1, 2, 3]


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], [" A b", "Unnamed: 0", "camelCase", "x-y", "x_y"])
    assert A.standardize_column_names(df)[0].columns == ["a_b", "column_0", "camel_case", "x_y", "x_y_1"]


def test_findings_on_dirty_people(spark):
    rows = [(f"P{k} ", "N/A" if k % 5 == 0 else "2024-01-02", f"${k},000", f"user{k}@x.org", "01234", "yes" if k % 2 else "No", 150.0 if k == 3 else 30.0 + k % 7) for k in range(60)]
    df = spark.createDataFrame(rows, "`Full Name` string, joined string, salary string, email string, zip string, active string, age double")
    ids = {f.id.split("-")[0]: f for f in scan(df)}
    assert {"sentinel", "ws", "colnames", "numtext", "booltext", "pii", "age", "const"} <= set(ids)
    assert ids["numtext"].columns == ["salary"] and ids["pii"].evidence["kind"] == "email"
    assert scan(spark.createDataFrame([], "a string"))[0].severity == "critical"
    twice = spark.createDataFrame([(1, 2)], "a long, b long").toDF("a", "a")
    assert scan(twice)[0].id.startswith("dupcolname")


def test_plan_rules(spark):
    df = spark.createDataFrame([(1.0, "x")], "user_id double, when string")
    miss = Finding("miss-1", "missing", "low", "t", "d", ["user_id"], suggested_action="fill_missing", suggested_params={"columns": ["user_id"]})
    date = Finding("dttext-1", "dtype", "high", "t", "d", ["when"], {"ambiguous": True}, "cast_datetime", {"columns": ["when"], "dayfirst": False})
    plan = {p.finding_id: p for p in build_plan(df, [miss, date])}
    assert plan["miss-1"].action == plan["dttext-1"].action == "none"
    plan = {p.finding_id: p for p in build_plan(df, [miss, date], date_order="dmy")}
    assert plan["dttext-1"].params["dayfirst"] is True and plan["dttext-1"].source == "user"
    assert risk_of("handle_outliers", {"method": "flag"}) == "low" and risk_of("enforce_range", {"mode": "drop_rows"}) == "high"
    assert [p.approved for p in review(list(plan.values()), "medium")].count(True) == 1
    assert refusal(plan["dttext-1"], Finding("x", "a", "low", "", "", ["gone"]), df) is None


def test_cleaner_replays_to_the_same_table(spark, tmp_path):
    text = "name,joined,salary\n Ann ,2024-01-02,100\nBob,N/A,200\nCid,2024-03-04,300\n Dee,N/A,400\nEve,2024-05-06,500\n"
    c = Cleaner(spark, text)
    out = c.run()
    assert values(out, "name") == ["Ann", "Bob", "Cid", "Dee", "Eve"] and values(out, "joined").count(None) == 2
    again = replay(read_any(spark, text), json.dumps(c.recipe(), default=str)).drop(RID)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, out.collect()))
    assert not c.act("enforce_range", column="salary", min=10**6, mode="drop_rows").ok and c.df.count() == 5
    made = c.export(str(tmp_path / "out.csv"))
    assert json.load(open(made["report"]))["summary"]["steps_failed"] == 1


@pytest.mark.parametrize("fmt", sorted(FORMATS))
def test_formats_round_trip(spark, fmt):
    df = spark.createDataFrame([(1, "a,b", 1.5), (2, None, 2.5), (3, 'q"x\ny', 3.5)], "i long, s string, x double").coalesce(1)
    back = load_bytes(spark, to_bytes(df, fmt), f"t.{fmt}")
    assert sorted(map(tuple, back.select("i", "s", "x").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("ext", ["parquet", "orc", "xml", "sqlite", "feather", "html", "md", "csv", "tsv", "jsonl"])
def test_files(spark, tmp_path, ext):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i long, s string").coalesce(1)
    path = write_any(df, str(tmp_path / f"t.{ext}"))
    if ext != "md":
        assert sorted(map(tuple, read_any(spark, path).select("i", "s").collect())) == [(1, "a"), (2, "b")]


def test_odd_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("n;v\ncafé;1\n".encode("cp1252"))
    (tmp_path / "b.csv").write_text("n;v\nx;2\n")
    got = read_any(spark, str(tmp_path)).orderBy("v")
    assert values(got, "n") == ["café", "x"] and values(got, "__source_file__") == ["a.csv", "b.csv"]
    assert records(spark, {"rows": [{"a": {"b": {"c": 1}}}, {"a": {"b": {"c": 2}}}]}).columns == ["a.b.c"]
    with pytest.raises(DataError):
        csv_text(spark, "a,b\n1,2,3\n", strict=True)
    with pytest.raises(DataError):
        read_any(spark, "x.pkl")


def test_service(spark):
    s = Service(spark)
    out = s.clean(csv_text="name,v\n a ,1\nb,N/A\nc,3\n")
    assert out["steps"] and s.download(out["file"]["token"])[1].startswith(b"name,v")
    with pytest.raises(DataError):
        s.apply_action(out["dataset_id"], "drop_columns", {"columns": ["v"]})
    assert s.preview(out["dataset_id"], 2)["rows"][0]["name"] == "a" and len(s.actions()) == 24
    s.delete(out["dataset_id"])
    with pytest.raises(DataError):
        s.plan(out["dataset_id"])


def test_stream(spark, tmp_path):
    spark.createDataFrame([(" a ", "N/A"), ("b", "x")], "s string, t string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s string, t string").parquet(str(tmp_path / "in"))
    q = start(stream, [("strip_whitespace", {"columns": ["s"]}), ("replace_sentinels_with_na", {"columns": ["t"]})], str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("a", None), ("b", "x")]
    with pytest.raises(DataError):
        replay_stream(stream, [("fill_missing", {"columns": ["t"]})])


def test_audit_and_name_scan_take_all_rows(spark, monkeypatch):
    from tablewright.plans import catalogue

    d, seen = SF.replace("0.001", "0.01"), []
    rows = catalogue.QUERIES["audit_trail"](spark, d).collect()
    assert rows[0]["rows_before"] == spark.read.parquet(f"{d}/orders.parquet").count() > 2000
    monkeypatch.setattr(catalogue, "found", lambda df, kind: seen.append(df.count()) or [])
    catalogue.QUERIES["name_scan"](spark, d)
    assert seen == [spark.read.parquet(f"{d}/lineitem.parquet").count()]


def test_mixed_date_forms(spark):
    forms = {
        "03/04/2024 14:30": "2024-03-04 14:30:00", "03/04/2024 2:30 PM": "2024-03-04 14:30:00", "March 5, 2024": "2024-03-05 00:00:00", "31-Jan-2024": "2024-01-31 00:00:00",
        "Jan 5 2024": "2024-01-05 00:00:00", "2024-01-02T03:04:05": "2024-01-02 03:04:05", "31/12/2023 08:15:10": "2023-12-31 08:15:10", "no date": None,
    }
    df = A.cast_datetime(spark.createDataFrame([(k, k) for k in forms], "a string, b string"), ["b"])[0]
    assert {r["a"]: str(r["b"]) if r["b"] else None for r in df.collect()} == forms


def test_patterns_count_long_values_and_repeats(spark):
    long = "x" * 400 + "  Ã"
    p = Profile(spark.createDataFrame([("N/A",)] * 3 + [(long,)] * 2 + [(None,), ("a b",)], "t string"))
    s = p.stats["t"]
    assert (s["filled"], s["sentinels"], s["mojibake"], s["spaced"], p.rows) == (6, 3, 2, 2, 7)
    p.close()


def test_failed_check_is_told(spark, monkeypatch):
    def broken(p):
        raise RuntimeError("no luck")

    df = spark.createDataFrame([(1,)], "a int")
    assert [f.id.split("-")[0] for f in scan(df, [broken])] == ["failed"]


def test_blocks_are_even_whatever_the_order_column(spark):
    df = spark.range(5000).select((F.col("id") * F.col("id") * F.col("id")).alias("o"))
    sizes = [r["count"] for r in A._blocks(df, "o", 64).groupBy("block_").count().collect()]
    assert len(sizes) > 50 and max(sizes) < 3 * 5000 / 64
    got = A._positions(A._blocks(df, "o", 64), "o").orderBy("o").select("pos_").collect()
    assert [r[0] for r in got] == list(range(1, 5001))


@pytest.mark.parametrize(("text", "mark"), [("a,b;c\n1,2;3\n4,5;6", ","), ("a;b\n1,2;3,4\n", ";"), ("a|b\n1|2", "|"), ("a\n1;2", ",")])
def test_delimiters(text, mark):
    assert sniff_delimiter(text) == mark
