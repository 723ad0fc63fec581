"""Notes and pages as text, and the planned operations, on values worked out by hand."""

from pyspark.sql import functions as F

from marlstone.operators import notes
from marlstone.sources.readers import front_matter


def test_notes(spark):
    row = spark.sql("SELECT 'Doc' d, 3 n, 'Un \"titolo\"' t, 4 p, 6 q, 'vedi [[x]]' e")
    note = row.select(notes.section_note(*[F.col(c) for c in ("d", "n", "t", "p", "q", "e")]).alias("note")).first().note
    assert note.endswith("Pagina: 4-6\n\n> vedi \\[\\[x\\]\\]") and 'titolo: "Un \\"titolo\\""' in note
    held = spark.createDataFrame([(note,)], "note string")
    assert held.select(front_matter(F.col("note")).alias("m")).first().m["pagina_fine"] == "6"
    again = held.select(notes.rewritten_note(F.col("note"), F.lit("T"), F.array(F.lit("uno")), F.lit(" corpo "), F.lit("mat"), F.array(F.lit("5")), F.lit(0.7)).alias("v")).first().v
    assert "avviso_segnaposti: true" in again and "frazione_segnaposti: 0.7000" in again and again.index("## In breve") < again.index("## La spiegazione") < again.index("## Materiale originale") and again.endswith("⚠ 1 numeri non verificati")
    bare = held.select(notes.rewritten_note(F.col("note"), F.lit("T"), F.expr("cast(array() as array<string>)"), F.lit("c"), F.lit(""), F.expr("cast(array() as array<string>)"), F.lit(0.1)).alias("v")).first().v
    assert "(punti chiave non disponibili)" in bare and "Materiale" not in bare and "avviso" not in bare


def test_pages(spark):
    body = spark.sql("SELECT 'prosa' p, array('1 2', '') t, array('x^2') f, 7 n").select(notes.page_body(F.col("p"), F.col("t"), F.col("f"), F.col("n")).alias("v")).first().v
    assert body == "prosa\n\n<!-- tabella pag 7 blocco 1 -->\n\n```\n\n1 2\n\n```\n\n<!-- formula pag 7 blocco 1 -->\n\n```\n\nx^2\n\n```"
    pages = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "doc_id int, page int")
    assert [tuple(r) for r in notes.missing_pages(pages, pages.limit(1)).orderBy("doc_id", "page").collect()] == [(1, 2), (2, 1)]
    words = spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0, 9.0, "a"), (1, 1, 6.0, 0.0, 9.0, 9.0, "b"), (1, 1, 0.0, 10.0, 5.0, 19.0, "c"), (1, 1, 50.0, 0.0, 55.0, 9.0, "out")], "doc_id int, page int, x0 double, y0 double, x1 double, y1 double, txt string")
    boxes = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 20.0, 20.0)], "doc_id int, page int, block int, x0 double, y0 double, x1 double, y1 double")
    assert notes.words_in_box(words, boxes).first().body == "a b\nc"


def test_page_assembly_keeps_the_whole_prose(spark, tmp_path):
    from marlstone.plans.note_queries import page_assembly

    line = " ".join("parola" + chr(97 + i % 26) for i in range(200))
    spark.createDataFrame([(1, f" {line}\n```a``` {line}.\n{line} ")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.page, r.body) for r in page_assembly(spark, str(tmp_path)).collect()] == [(1, f"{line} ```a``` {line}. {line}")]


def test_styled_lines(spark):
    pieces = [(1, 1, 0.0, 0.0, 5.0, 10.0, 12.0, "P"), (1, 1, 2.0, 5.5, 20.0, 8.0, 9.0, "REFACE"), (1, 1, 0.0, 40.0, 9.0, 10.0, 12.0, "due"), (1, 1, 30.0, 0.0, 9.0, 10.0, 12.0, " sotto "), (1, 1, 30.0, 9.0, 9.0, 10.0, 12.0, " ")]
    df = spark.createDataFrame(pieces, "doc_id int, page int, top double, left_ double, width double, height double, size double, text string")
    assert [(r.top, r.size, r.text) for r in notes.styled_lines(df).orderBy("line").collect()] == [(0.0, 12.0, "PREFACE due"), (30.0, 12.0, "sotto")]


def test_small_ones(spark):
    turns = spark.createDataFrame([(0, 0, 5, 0.0), (52000, 26000, 10, 4.0)], "prompt long, cached long, generated long, seconds double")
    assert [(r.cached_percent, r.near_limit, r.tokens_s) for r in notes.turn_measures(turns).orderBy("prompt").collect()] == [(0.0, False, 0.0), (50.0, True, 2.5)]
    images = spark.sql("SELECT * FROM VALUES (array('a', 'b'), 'image/png', 'd'), (array(), 'image/png', 'd'), (array(), 'text/plain', 'd') AS t(p, k, d)")
    assert [r.v for r in images.select(notes.image_of(F.col("p"), F.col("k"), F.col("d")).alias("v")).collect()] == ["b", "d", None]
    echoes = spark.createDataFrame([("il gatto nero dorme", "il gatto nero corre via"), ("x", "y"), ("a b c", "a b")], "s string, r string")
    assert [r.v for r in notes.echo(echoes, "s", "r").withColumnRenamed("echo", "v").collect()] == [1 / 3, 0.0, 0.0]
    found = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3), (1, 3, 2), (1, 4, 1)], "doc_id int, seq int, level int")
    assert [r.parent for r in notes.parents(found).orderBy("seq").collect()] == [None, 0, 1, 0, None]
