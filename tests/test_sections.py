from sparkloom.operators import sections as s

PAGE = """front matter
# Title { #top }
intro
````py
# no heading
```
## still none? the fence is closed by three marks
## One
a
## One
{* ../../src/a.py ln[2:3] *}
{* ../../src/gone.py *}
~~~
## no
```
~~~
### Deep *x*
"""


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, text string")


def test_split(spark):
    p = pages(spark, ("tutorial/x.md", PAGE), ("no-heads.md", "just\ntext"), ("empty.md", " \n"), ("crlf.md", "# A\r\nb\r\n"))
    got = s.split_pages(p, "docs", "https://x/")
    rows = got.where("doc_id = 'doc:tutorial/x'").orderBy("lines.start").collect()
    assert [(r.heading, r.level, r.anchor, tuple(r.lines)) for r in rows] == [("Title", 1, "top", (2, 6)), ("still none? the fence is closed by three marks", 2, "still-none-the-fence-is-closed-by-three-marks", (7, 7)), ("One", 2, "one", (8, 9)), ("One", 2, "one-2", (10, 16)), ("Deep *x*", 3, "deep-x", (17, 17))]
    assert {r.doc_title for r in rows} == {"Title"} and rows[0].url == "https://x/tutorial/x/" and rows[2].url.endswith("#one")
    alone = got.where("doc_id = 'doc:no-heads'").collect()
    assert [(r.heading, r.level, r.text) for r in alone] == [("No Heads", 1, "just\ntext")]
    assert got.where("doc_id = 'doc:empty'").count() == 0 and got.where("doc_id = 'doc:crlf'").collect()[0].text == "# A\nb"
    assert s.broken_cuts(got, p).count() == 0 and s.page_docs(got).count() == 3


def test_code(spark):
    got = s.split_pages(pages(spark, ("tutorial/x.md", PAGE)))
    full = s.with_code(got, pages(spark, ("src/a.py", "l1\nl2\nl3\nl4")))
    rows = {r.anchor: r for r in full.collect()}
    assert [(c.path, tuple(c.lines), c.text) for c in rows["one-2"].code] == [("src/a.py", (2, 3), "l2\nl3")] and rows["one"].code is None
    assert rows["one-2"].embed_text.endswith("\n\nl2\nl3") and full.count() == got.count()


def test_stats(spark):
    df = spark.createDataFrame([("a", 10, [1]), ("b", 300, []), ("c", 500, None), ("d", 20, [2])], "id string, chars int, code array<int>")
    assert tuple(s.size_stats(df).collect()[0]) == (4, 300, 500, 2, 2)


def test_no_two_anchors_are_alike(spark):
    """Headings that look like a numbered repeat of others, in every order."""
    import itertools

    from pyspark.sql import functions as F

    pages_ = [list(x) for x in itertools.product(("a", "a-2", "a-3", "b"), repeat=4)]
    got = [r.x for r in spark.createDataFrame([(x,) for x in pages_], "s array<string>").select(s.anchors(F.col("s")).alias("x")).collect()]
    for page, names in zip(pages_, got, strict=True):
        assert len(set(names)) == len(page) and all(n.startswith(p) for n, p in zip(names, page, strict=True))
        assert all(names[i] == p for i, p in enumerate(page) if p not in page[:i])
