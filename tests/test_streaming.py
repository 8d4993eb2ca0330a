from starql.engine import Engine
from starql.sources import Catalog
from starql.streaming import add_growing_csv, start


def test_folder_that_grows(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    cat = add_growing_csv(Catalog(spark), "sales", str(inbox), [("shop", "int"), ("item", "string"), ("n", "int")])
    cat.add("shops", spark.createDataFrame([(1, "north"), (2, "south")], "id long, name string"))
    engine = Engine(cat)
    (inbox / "a.csv").write_text("shop:int,item:string,n:int\n1,tea,3\n2,NULL,4\n")
    flat = start(engine, "SELECT s.name AS shop, x.item AS item, x.n AS n FROM sales x JOIN shops s ON x.shop = s.id WHERE x.n > 2", str(tmp_path / "out"), str(tmp_path / "c1"))
    sums = start(engine, "SELECT x.shop AS shop, SUM(x.n) AS n, COUNT(*) AS c FROM sales x GROUP BY x.shop", "sums", str(tmp_path / "c2"), "complete")
    try:
        flat.processAllAvailable()
        (inbox / "b.csv").write_text('shop:int,item:string,n:int\n1,"a, b",5\n2,tea,1\n')
        flat.processAllAvailable()
        sums.processAllAvailable()
        got = sorted(map(repr, map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())))
        assert got == sorted(map(repr, [("north", "tea", 3), ("south", None, 4), ("north", "a, b", 5)]))
        assert sorted(map(tuple, spark.table("sums").collect())) == [(1, 8, 2), (2, 5, 2)]
    finally:
        flat.stop()
        sums.stop()
