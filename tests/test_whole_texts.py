"""Queries over whole texts, where others run on parts of them."""

from logoscope.plans import catalog


def test_dominant_script_of_whole_texts(spark, tmp_path):
    """A script that shows only after the fourth character."""
    rows = [(1, "abcd" + "\u0416" * 40, "en", "s"), (2, "abcd" * 10, "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("dominant_script_whole", "script_to_language_whole"):
        found = {r.row_id: r.dominant for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
        assert found[2] == "CYRILLIC" and found[4] is None and set(found) == {2, 3, 4, 5}
