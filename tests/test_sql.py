from loamwork.plans.sql import register


def test_registered_functions(spark):
    register(spark)
    spark.createDataFrame([(1, "T", "# H\n\nbody", "<main><h1>T</h1><a href='x/'>l</a></main>"), (2, None, None, None)], "id int, title string, markdown string, html string").createOrReplaceTempView("sql_docs")
    got = spark.sql("SELECT d.id, c.chunk_index, c.chunk_text FROM sql_docs d, LATERAL chunk_markdown(d.title, d.markdown) c").collect()
    assert [tuple(r) for r in got] == [(1, 0, "T > H\n\nbody")]
    got = spark.sql("SELECT d.id, e.title, e.child_links FROM sql_docs d, LATERAL extract_html(d.html, 'https://h.example/') e ORDER BY id").collect()
    assert [tuple(r) for r in got] == [(1, "T", ["https://h.example/x/"]), (2, "", [])]
    assert spark.sql("SELECT normalize_url('/a#b', 'https://h.example/x')").first()[0] == "https://h.example/a"
