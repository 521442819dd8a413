"""Questions in SQL alone."""

from __future__ import annotations

import pytest

from quillmesh import surface

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def asked(spark):
    return surface.register(spark, SF, "surf_")


def test_words_find_documents_as_the_facade_does(spark, asked):
    from quillmesh.facade import Corpus

    word = spark.sql("SELECT max_by(w, n) FROM (SELECT w, count(*) AS n FROM (SELECT explode(regexp_extract_all(lower(text), '([a-z]{5,})', 1)) AS w FROM surf_documents) GROUP BY w HAVING n < 60)").first()[0]
    got = spark.sql(f"SELECT * FROM surf_search_documents('what about {word}', 5) ORDER BY score DESC, doc_id").collect()
    assert len(got) == 5 and all(r.score > 0 for r in got)
    assert {r.doc_id for r in got} & {r.doc_id for r in Corpus(spark, SF).search(f"{word}", 5).collect()}


def test_validity_takes_any_table(spark, asked):
    spark.createDataFrame([("a", 1, "x"), ("a", 3, "x"), ("a", 5, "y"), ("b", 2, "x")], "k string, s int, c string").selectExpr("k", "c",
        "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, s) AS at").createOrReplaceTempView("surf_rows")
    got = spark.sql("SELECT k, c, second(valid_from) AS a, second(valid_to) AS b FROM surf_validity(TABLE(surf_rows), 'at', 'c', 'k')").collect()
    assert sorted(map(tuple, got), key=str) == [("a", "x", 1, 5), ("a", "y", 5, None), ("b", "x", 2, None)]
    with pytest.raises(Exception, match="no column z"):
        spark.sql("SELECT * FROM surf_validity(TABLE(surf_rows), 'z', 'c', 'k')").collect()


def test_each_row_is_parsed_in_its_language(spark, asked):
    rows = spark.sql("""SELECT l, p.name FROM VALUES ('python', 'def f(): pass'), ('go', 'func g() {}'), ('none', 'h'), (NULL, 'i'), ('rust', NULL) v(l, t), LATERAL surf_parse_code(t, l) p WHERE part = 'node'""")
    assert sorted(map(tuple, rows.collect())) == [("go", "g"), ("python", "f")]
