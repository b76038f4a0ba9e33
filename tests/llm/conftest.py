import pytest

from ferrytrace.llm.queries import workers_find_package


@pytest.fixture(scope="session", autouse=True)
def package_on_workers(spark):
    workers_find_package(spark)


# Awkward documents: null and empty texts, null and repeated ids, equal rows, ties, a long text.
LONG = "The quick brown foxes jump. " * 4000
PASSAGE = " ".join(f"word{i}" for i in range(120)) + "."
EDGE_ROWS = [
    (1, "Hello world, this is one document.\nIt has two lines.", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \t\n ", "en"),
    (5, "12345 67890 !!!", "en"),
    (6, LONG, "en"),
    (7, "same text in equal rows " + PASSAGE, "en"),
    (7, "same text in equal rows " + PASSAGE, "en"),
    (8, "same text in equal rows " + PASSAGE, "en"),
    (9, "other start " + PASSAGE + " other end", "en"),
    (None, "a row without an id, mail a.b@example.com", "en"),
    (None, None, None),
    (10, "ünïcödé 中文 😀 text\x00with a zero byte", "xx"),
    (11, "word", "en"),
]
# Names that the operators use inside.
CLASHING = "t1 t2 key keys row digests score component kept_t1 found_values TEXT_ p ids c1 at tie block".split()


@pytest.fixture(scope="session")
def edge(spark):
    names = ", ".join(f"{c} string" for c in CLASHING)
    rows = [(*r, "src", 0, *["x"] * len(CLASHING)) for r in EDGE_ROWS]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {names}"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
