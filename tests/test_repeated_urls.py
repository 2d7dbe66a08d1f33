"""pages whose rows share urls, and pages that only their headings make long enough: the registered queries against their SQL."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

HTML = (
    "<html><head><title>{title}</title></head><body><nav><ul>{nav}</ul></nav><article><h1>{title}</h1><p>{text}</p></article>"
    "<footer>f</footer></body></html>"
)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    long, title = "word " * 60, " ".join(f"title{i}" for i in range(12))
    nav = lambda *names: "".join(f'<li><a href="/{n}">{n}</a></li>' for n in names)
    rows = [
        (1, "https://b.example/x", HTML.format(title="One", nav=nav("a", "b", "a", "c"), text=long)),
        (2, "https://b.example/x", HTML.format(title="Two", nav=nav("a", "b", "b", "b", "d"), text=long + "more")),
        (3, "https://b.example/short#top", HTML.format(title=title, nav="", text="Too short.")),
        (4, "https://a.example/", HTML.format(title="Four", nav=nav("e"), text=long)),
        (6, "https://a.example/", HTML.format(title="Six", nav=nav("e"), text=long)),
        (11, "https://c.example/", HTML.format(title="Eleven", nav="", text=long)),
        (21, "https://e.example/", HTML.format(title="Twenty", nav="", text="word " * 35)),
        (12, "https://d.example/", HTML.format(title="Twelve", nav="", text=long)),
    ]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", ["html_links", "store_page_texts", "store_resync", "store_delete"])
def test_rows_that_share_a_url(spark, folder, name):
    found = Counter(tuple(r) for r in entry.queries()[name](spark, folder).collect())
    engine = duckdb.connect()
    engine.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    assert found == Counter(engine.sql(entry.oracle_sql()[name]).fetchall())
