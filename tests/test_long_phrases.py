"""Names late in a text, and labels of many words."""

from lorewell.operators import lookups, mapping

from .test_whole_job import rows


def test_names_late_in_a_text(spark):
    text = " ".join(f"w{i}" for i in range(40)) + " Red Dog"
    t = spark.createDataFrame([(1, text)], "id int, text string")
    assert rows(mapping.fragment_search(t, spark.createDataFrame([("red dog", "RD"), ("w3", "W")], "name string, concept string"))) == [(1, "Red Dog", "RD")]
    assert mapping.fragments(t).count() == 42 * 43 // 2
    assert mapping.fragment_search(t, spark.createDataFrame([], "name string, concept string")).count() == 0


def test_labels_of_many_words(spark):
    t = spark.createDataFrame([(1, "on The Rise and Fall of the Old House")], "id int, text string")
    labels = spark.createDataFrame([("the rise and fall of the old", 1), ("house", 2)], "label string, target int")
    assert rows(lookups.annotate(t, labels), "at", "size", "target") == [(1, 7, 1), (8, 1, 2)]
