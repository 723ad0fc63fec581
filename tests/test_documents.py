"""Queries over documents on texts that the small tables lack, against their SQL."""

import duckdb
import pyarrow as pa
import pytest

from marlstone.operators import chunking
from marlstone.plans import catalogue


@pytest.fixture
def same(spark, tmp_path):
    """Checks that queries give the rows of their SQL over documents (doc_id, text)."""

    def check(name, rows):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet", mode="overwrite")
        ours = catalogue.queries()[name](spark, str(tmp_path)).toArrow()
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        theirs = con.sql(catalogue.oracle_sql()[name]).to_arrow_table().select(ours.column_names)
        plain = lambda t: sorted(repr(list(r.values())) for r in t.to_pylist())
        assert plain(ours) == plain(theirs)
        return ours.to_pylist()

    return check


def sections(*titles):
    """A text with a title of each given size 14, 16 or 18 and a long line below it."""
    return "\n".join(line for size, title in titles for line in (title + "." * (-(len(title) - size // 2 + 7) % 3), "t" * 210))


def test_titles_that_begin_with_digits_count(same):
    text = sections((14, "breve"), (18, "Capitolo"), (16, "4501042323994846 Anth heoron"), (16, "Parte"), (18, "56.187.231.175 Keit"), (16, "Altra"))
    assert {"1", "1.1", "1.2", "2", "2.1"} <= {r["number"] for r in same("section_numbering", [(1, text)])}


def test_names_are_counted(same):
    rows = same("section_numbering", [(1, "\n".join(f"{title}\n{'t' * 210}" for title in ("Capit (2)", "Capit", "Capit")))])
    assert sorted(r["name"] for r in rows) == ["Doc 1 Capit", "Doc 1 Capit (2)", "Doc 1 Capit (2)"]


ODD = [(1, "uno due  1,5 tre\n\n 12 34 5.6 78 9012 3,4\nquattro\n5 1234 6 7890 8 9\n" + "parola " * 300), (2, None), (3, ""), (4, "\n\n\n\nè sola"), (5, "  "), (6, "a 1234 5678\nbb"), (6, "a 1234 5678\nbb")]
NAMES = ["table_blocks", "line_islands", "styled_lines"]


@pytest.mark.parametrize("name", NAMES)
def test_words_are_no_rows(spark, same, tmp_path, name):
    """Texts are dealt out once, and neither words nor lines are sorted; texts of one document lie in each other."""
    same(name, ODD)
    plan = catalogue.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("RepartitionByExpression") == 1
    assert ("Window" in plan) == (name == "table_blocks")


@pytest.mark.parametrize("name", ["page_structure", "page_assembly"])
def test_pages_are_made_in_the_worker(spark, tmp_path, name):
    """Words aren't rows here either. The state of a page: a table of lines 3 and 4 with its ragged last row, and a formula."""
    text = "uno\ndue\ntre\n1 4444 5 4444 1 2 3\n7 5555 6 5555 4 5 6\n99\n∞ = a"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    frame = catalogue.queries()[name](spark, str(tmp_path))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "FlatMapGroups" not in plan and plan.count("RepartitionByExpression") == 1
    got = sorted(frame.collect(), key=lambda r: r.page)
    if name == "page_structure":
        assert [(r.page, r.kind, r.block, r.x0, r.y0, r.x1, r.y1, r.body) for r in got] == [(2, "table", 0, 0.0, 36.0, 174.0, 70.0, None), (3, "formula", 0, None, None, None, None, "∞ = a")]
    else:
        table = "1 4444 5 4444 1 2 3\n7 5555 6 5555 4 5 6\n99"
        assert [(r.page, r.body) for r in got] == [(1, "uno due tre"), (2, f"1 4444 5 4444 1 2 3 7 5555 6 5555 4 5 6 99\n\n<!-- tabella pag 2 blocco 1 -->\n\n```\n\n{table}\n\n```"), (3, "∞ = a\n\n<!-- formula pag 3 blocco 1 -->\n\n```\n\n∞ = a\n\n```")]


def test_chunks_go_in_pieces():
    """A worker holds a piece of a batch's texts and chunks, not the batch's."""
    texts = ["frase uno. " * 300, None, "", "x" * (chunking.AT_ONCE + 5), *["parola " * 2000] * 200]
    pieces = list(chunking._pieces([pa.array(texts), pa.array(["breve"])], 1000))
    assert sum(map(len, pieces)) == 205 and len(pieces) > 3
    assert all(sum(len(c) for row in p.to_pylist() for c in row["chunks"] or []) <= chunking.AT_ONCE + 20_000 for p in pieces[1:])
    rows = [row for p in pieces for row in p.to_pylist()]
    assert rows[1] == {"chunks": None} | dict.fromkeys(chunking.LEVELS)
    assert [(r["chunks"], {n: r[n] for n in chunking.LEVELS}) for r in rows[2:4]] == [chunking.chunked(t, 1000) for t in texts[2:4]]
