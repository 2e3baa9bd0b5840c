from sedimenta.plans.site_run import SiteRun
from sedimenta.sources.store import Store
from sedimenta.spec import parse_site
from sedimenta.streaming import captured

SITE = {"name": "s", "base_url": "https://s.example", "start_urls": ["/"], "list": {"item_selector": "li", "fields": {"t": {"required": True}}}, "key": ["t"]}


def test_batches_of_pages_are_upserted_once(spark, tmp_path):
    folder, store, site = str(tmp_path / "in"), Store(spark, str(tmp_path / "store")), parse_site(SITE)
    page = lambda body: spark.createDataFrame([("https://s.example/", None, 200, body, None)], captured.PAGES)
    page("<li>a<li>b").write.parquet(folder)
    for _ in range(2):
        captured.follow(captured.read_pages(spark, folder), site, store, str(tmp_path / "c")).awaitTermination()
    assert sorted(r["natural_key"] for r in store.items().collect()) == ["a", "b"] and store.log("runs").count() == 1
    page("<li>b<li>c").write.mode("append").parquet(folder)
    captured.follow(captured.read_pages(spark, folder), site, store, str(tmp_path / "c")).awaitTermination()
    rows = {r["natural_key"]: r for r in store.items().collect()}
    assert sorted(rows) == ["a", "b", "c"] and rows["a"]["gone_at"] is None and rows["b"]["seen_run_id"] == 2
    assert SiteRun(spark, site, page("<li>c"), dry_run=True).run().items_new == 1


def test_a_list_and_its_detail_in_two_batches(spark, tmp_path):
    spec = {"list": {"item_selector": "li", "detail_url": "a::attr(href)", "fields": {"t": {"selector": "a"}}}, "detail": {"fields": {"d": {"selector": "p"}}}}
    folder, store, site = str(tmp_path / "in"), Store(spark, str(tmp_path / "store")), parse_site(SITE | spec)
    follow = lambda: captured.follow(captured.read_pages(spark, folder), site, store, str(tmp_path / "c")).awaitTermination()
    pages = [("https://s.example/", "<li><a href=/1>a</a>"), ("https://s.example/1", "<p>uno</p>")]
    for url, body in pages:
        spark.createDataFrame([(url, None, 200, body, None)], captured.PAGES).write.mode("append").parquet(folder)
        follow()
    assert [(r["id"], r["natural_key"], r["data"]) for r in store.items().collect()] == [(1, "a", '{"d":"uno","t":"a"}')]
    # a batch that comes again lands in its place and isn't run twice
    runs = store.log("runs").count()
    stream = next(iter(store.pointer.read()["batches"]))
    assert runs == 2 and store.batch(stream) == 1 and store.batch("other") == -1
