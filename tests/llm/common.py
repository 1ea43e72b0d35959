import pytest

from strata.llm.frames import importable


@pytest.fixture(autouse=True)
def workers(spark):
    importable(spark)


DOCS = "doc_id long, text string"


@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text) to a table with further columns whose names operators use inside."""
    def make(rows):
        return spark.createDataFrame([(*row, "x", 7, -1) for row in rows], f"{DOCS}, key string, row int, index int")
    return make


def table(df, *names):
    return sorted((tuple(row) for row in df.select(*names).collect()), key=repr)


def linked_groups(nodes, links):
    """Smallest node that each node reaches, by plain search."""
    near = {node: set() for node in nodes}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for node in sorted(nodes):
        if node in out:
            continue
        open_ = [node]
        while open_:
            at = open_.pop()
            if at not in out:
                out[at] = node
                open_.extend(near[at])
    return out
