from tidewater.__main__ import main
from tidewater.engine import Engine
from tidewater.sources.sinks import backup, export, lines, restore


def test_backup_and_restore(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    e.execute("type T { unique id: int, s: str }")
    e.execute('insert T { id := 1, s := "a" }, { id := 2 }')
    e.execute("materialize V as T filter .id > 1 { .id }")
    assert backup(e.catalog, f"file://{tmp_path}/saved") == 2
    e.execute("insert T { id := 3 }")
    assert backup(e.catalog, f"file://{tmp_path}/saved") == 1
    e.execute("T delete")
    restore(spark, f"file://{tmp_path}/saved", f"file://{tmp_path}/again")
    again = Engine(spark, f"file://{tmp_path}/again")
    assert sorted(r["id"] for r in again.dataframe("T").collect()) == [1, 2, 3]
    assert sorted(r["id"] for r in again.dataframe("V").collect()) == [2, 3]


def test_formats(spark, tmp_path, capsys):
    df = spark.createDataFrame([(1, 'a,"b"'), (2, None)], "id long, s string").coalesce(1).orderBy("id")
    assert list(lines(df, "csv")) == ["id,s", '1,"a,""b"""', "2,"]
    assert list(lines(df, "json")) == ['{"id":1,"s":"a,\\"b\\""}', '{"id":2}']
    assert list(lines(df, "table", None))[2].split() == ["1", "|", 'a,"b"']
    export(df, f"file://{tmp_path}/out", "csv")
    assert spark.read.option("header", "true").csv(f"file://{tmp_path}/out").count() == 2
    df.write.parquet(f"file://{tmp_path}/p")
    main(["--store", f"file://{tmp_path}/cli", "--format", "csv", "--parquet", f"t=file://{tmp_path}/p:id", "t order .id desc limit 1 { .id }"], spark)
    assert capsys.readouterr().out.split() == ["id", "2"]
