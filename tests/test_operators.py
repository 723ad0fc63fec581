"""Operators on small tables whose results are worked out by hand or by a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import chunking, facts, fusion, geometry, media, retrieval, structure


def fused(spark, lists, **more):
    rows = [(1, n, pos, id_) for n, ids in enumerate(lists) for pos, id_ in enumerate(ids)]
    df = spark.createDataFrame(rows, "q int, list_no int, pos long, id string")
    return [(r.id, r.score) for r in fusion.fuse(df, by=["q"], **more).orderBy("rank").collect()]


def test_fusion(spark):
    assert [i for i, _ in fused(spark, [["a", "b", "c"], ["b", "d"]])] == ["b", "a", "d", "c"]
    assert fused(spark, [["a"], ["a"]]) == [("a", 1 / 61 + 1 / 61)]
    assert fused(spark, [["a", "a", "b"]]) == [("a", 1 / 61), ("b", 1 / 63)]  # a repeated id keeps its place
    assert [i for i, _ in fused(spark, [["a", "b"], ["b", "a"]])] == ["a", "b"]  # a tie goes to the one seen first
    assert fused(spark, [[], ["x"]]) == [("x", 1 / 61)] and fused(spark, [[]]) == []
    assert fused(spark, [["a", "b"]], k=0) == [("a", 1.0), ("b", 0.5)]
    assert [i for i, _ in fused(spark, [list("abcdef")], most=2)] == ["a", "b"]
    weights = spark.createDataFrame([(0, 1.0), (1, 3.0)], "list_no int, weight double")
    assert fused(spark, [["a"], ["b"]], weights=weights) == [("b", 3 / 61), ("a", 1 / 61)]
    with pytest.raises(Exception, match="weight"):
        fused(spark, [["a"], ["b"], ["c"]], weights=weights)


@pytest.mark.parametrize(
    ("sentence", "reason"),
    [
        ("Ieri sono andato al mare.", "prima persona"),
        ("Mi piace il caffè", "prima persona"),
        ("Come va?", "domanda"),
        ("Fammi un riassunto", "imperativo"),
        ("Allora ora dimmi tutto", "imperativo"),
        ("Puoi aiutarmi", "imperativo"),
        ("Hai torto marcio", "sull'assistente"),
        ("Non riesci proprio", "sull'assistente"),
        ("Ti parlo perché io voglio", "prima persona"),
        ("Bene", "troppo breve"),
        ("Piove sul tetto", "non sul parlante"),
        ("  ", "vuota"),
    ],
)
def test_verdicts(spark, sentence, reason):
    assert facts.judged(spark.createDataFrame([(sentence,)], "sentence string")).first().reason == reason


def test_context_and_counts(spark):
    rows = [(1, 0, "user", "Ieri sono uscito. Pioveva sul tetto. Come va? Bene."), (1, 1, "assistant", "Ho capito."), (1, 2, "user", "Pioveva forte. Fine."), (2, 0, "user", None)]
    found = facts.facts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("turn", "seq").collect()
    assert [(r.turn, r.kind, r.reason) for r in found] == [(0, "fact", "prima persona"), (0, "context", "non sul parlante"), (0, "discarded", "domanda"), (0, "discarded", "troppo breve"), (2, "discarded", "non sul parlante"), (2, "discarded", "troppo breve")]


def test_attribution(spark):
    said = spark.createDataFrame([(1, 0, "user", "Vado a correre ogni mattina al parco."), (1, 1, "assistant", "Bene, vai a correre ogni mattina al parco!"), (1, 2, "user", None)], "conv_id long, turn long, role string, text string")
    quoted = spark.createDataFrame([(1, 1, "vado a correre ogni mattina"), (1, 2, "CORRERE ogni mattina al parco"), (1, 3, "troppo corta"), (1, 4, "qualcosa che nessuno ha mai detto qui"), (1, 5, "quindi vai a correre ogni mattina presto")], "conv_id long, quote_id long, quote string")
    found = {r.quote_id: (r.quoted_role, r.match_len) for r in facts.attributed(quoted, said).collect()}
    assert found == {1: ("user", 27), 2: ("user", 29), 3: (None, 0), 4: (None, 0), 5: ("assistant", 26)}
    rates = facts.error_rates(facts.attributed(quoted, said), by=["conv_id"]).where("conv_id is null").first()
    assert (rates.n_quotes, rates.n_user, rates.n_assistant, rates.n_none, rates.wrong_share) == (5, 2, 1, 2, 0.2)


def test_quotes(spark):
    texts = ['- detto "uno" e "due"', "- EXPLICIT: il testo", "- ", 'x ""']
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(facts.quotes(F.col("t")).alias("v")).collect()
    assert [r.v for r in got] == [["uno", "due"], ["il testo"], [], ['x ""']]


def pack_by_hand(text, query, most, spark):
    """Greedy packing by a loop over scores that the score expression gives."""
    paras = [p.strip(" ") for p in text.split("\n") if len(p.strip(" ")) > 80]
    if not paras:
        return " ".join(text.split())[:most]
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(paras)], "i int, p string")
    scores = [r.s for r in frame.orderBy("i").select(retrieval.paragraph_score(F.col("p"), retrieval.keywords(F.lit(query)), F.col("i"), F.lit(len(paras))).alias("s")).collect()]
    order = sorted(range(len(paras)), key=lambda i: -scores[i])
    held, total = [], 0
    for i in order:
        if total + len(paras[i]) > most:
            continue
        held.append(i)
        total += len(paras[i])
        if total > 0.8 * most:
            break
    if not held:
        return " ".join(paras[order[0]].split())[:most]
    return "\n\n".join(paras[i] for i in sorted(held, key=lambda i: paras.index(paras[i])))


def test_passages(spark):
    rng = random.Random(5)
    words = "mare monte casa gatto cookie vino pane strada".split()
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(3, 60))) for _ in range(12)) for _ in range(6)] + ["corto", "x" * 900, "y " * 300 + "\n" + "y " * 300]
    for text in texts:
        df = spark.createDataFrame([(text, "gatto sul monte")], "t string, q string").select("t", retrieval.keywords(F.col("q")).alias("k"), retrieval.paragraphs(F.col("t")).alias("p"))
        got = df.select(retrieval.packed_passages(F.col("t"), F.col("k"), F.col("p"), 340).alias("v")).first().v
        assert got == pack_by_hand(text, "gatto sul monte", 340, spark)


def test_shortlist_and_budget(spark):
    urls = ["https://shop.it/", "https://www.a.it/x", "https://a.it/y", "nothing", "https://b.it/z?q", "https://c.it", "https://d.it/1", "https://e.it/2"]
    df = spark.createDataFrame([(1, i, u) for i, u in enumerate(urls)], "q int, pos int, url string")
    assert [r.url for r in retrieval.shortlist(df, by="q").orderBy("place").collect()] == ["https://www.a.it/x", "https://b.it/z?q", "https://d.it/1"]
    blocks = spark.createDataFrame([(1, 0, "x" * 50), (1, 1, "y" * 40), (1, 2, "z" * 20), (2, 0, "w" * 200)], "q int, pos int, block string")
    got = {r.q: (r.n_blocks, r.body) for r in retrieval.budgeted(blocks, by="q", most=95).collect()}
    assert got == {1: (2, "x" * 50 + "\n" + "y" * 40), 2: (1, "w" * 95)}


def test_bm25_gives_nothing_rather_than_the_least_bad(spark):
    queries = spark.createDataFrame([(1, "gatto nero"), (2, "assente")], "query_id int, text string")
    docs = spark.createDataFrame([(1, "gatto gatto nero"), (2, "cane nero"), (3, "cane bianco")], "doc_id int, text string")
    found = retrieval.bm25(queries, docs, key="doc_id").orderBy("query_id", F.desc("score")).collect()
    assert [(r.query_id, r.doc_id) for r in found] == [(1, 1), (1, 2)]


def number_by_hand(items):
    import re

    out, cap, sub, subsub = [], 0, 0, 0
    for i, (level, title) in enumerate(items):
        if re.match(r"^\d+(\.\d+)*\.?\s+", title):
            out.append(None)
        elif level == 1:
            cap, sub, subsub = (cap + 1 if i + 1 < len(items) and items[i + 1][0] > 1 else 0), 0, 0
            out.append(str(cap) if cap else None)
        elif level == 2:
            sub, subsub = sub + 1, 0
            out.append(f"{cap}.{sub}" if cap else None)
        else:
            subsub += 1
            out.append(f"{cap}.{sub}.{subsub}" if cap and sub else None)
    return out


def test_numbering_by_hand(spark):
    rng = random.Random(2)
    docs = [[(rng.choice([1, 1, 2, 2, 3]), rng.choice(["Intro", "Esercizi", "1.2 Gia", "Altro"])) for _ in range(rng.randrange(1, 14))] for _ in range(40)]
    rows = [(d, i, level, title, 1) for d, items in enumerate(docs) for i, (level, title) in enumerate(items)]
    found = structure.named(structure.numbered(spark.createDataFrame(rows, "doc_id int, seq int, level int, title string, page int")), F.lit("DSML")).orderBy("doc_id", "seq").collect()
    assert [r.number for r in found] == [n for items in docs for n in number_by_hand(items)]
    assert all(len({r.name for r in found if r.doc_id == d}) == len(items) for d, items in enumerate(docs))


def test_sections(spark):
    lines = [(1, 0, 1, 20.0, "DEDICA"), (1, 1, 1, 10.0, "breve"), (1, 2, 2, 20.0, "Capitolo"), (1, 3, 2, 10.0, "t" * 90), (1, 4, 5, 15.0, "Parte"), (1, 5, 5, 10.0, "u" * 80), (1, 6, 5, 15.0, "x")]
    found = structure.sections(spark.createDataFrame(lines, "doc_id int, seq int, page int, size double, text string")).orderBy("seq").collect()
    assert [(r.title, r.under, r.kept, r.level) for r in found] == [("DEDICA", 5, False, None), ("Capitolo", 90, True, 1), ("Parte", 80, True, 2)]
    ends = structure.with_end_pages(spark.createDataFrame([(1, 0, 2), (1, 1, 2), (1, 2, 9)], "doc_id int, seq int, page int"), F.lit(12)).orderBy("seq").collect()
    assert [r.page_end for r in ends] == [2, 8, 12]


@pytest.mark.parametrize(("values", "middle"), [([1, 2, 3, 9], 3), ([5], 5), ([1, 1, 2], 1), ([1, 2], 2), ([4, 4, 4, 1], 4)])
def test_upper_median(spark, values, middle):
    df = spark.createDataFrame([("a", v) for v in values], "k string, v int")
    assert structure.upper_median(df, by="k", value="v").first().upper_median == middle


def test_links_and_pending(spark):
    notes = spark.createDataFrame([("n", r"[[a]] [[ b ]] [[a]] \[[c]] [[x|y]]")], "note string, body string")
    got = structure.resolved_links(notes, spark.createDataFrame([("a",)], "target string")).first()
    assert (got.n_links, got.n_resolved, got.orphans) == (3, 2, ["b"])
    work = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h3")], "id int, hash string")
    done = spark.createDataFrame([(1, "h1"), (2, "old")], "id int, hash string")
    assert [r.id for r in structure.pending(work, done, keys=["id", "hash"]).orderBy("id").collect()] == [2, 3]
    first = structure.next_pending(work.withColumn("doc", F.lit("d")), done, keys=["id"], by="doc", order="id").first()
    assert first.id == 3


def test_figures(spark):
    images = [(1, "h", 300, 300), (1, "h", 300, 300), (1, "i", 20, 400), (1, "j", 900, 100), (1, "k", 200, 300), (2, "h", 300, 300)]
    got = media.raster_verdicts(spark.createDataFrame(images, "doc_id int, hash string, w int, h int")).collect()
    assert sorted((r.doc_id, r.hash, r.verdict) for r in got) == [(1, "h", "decoration"), (1, "h", "decoration"), (1, "i", "glyph"), (1, "j", "ruler"), (1, "k", "figure"), (2, "h", "figure")]
    caps = spark.createDataFrame([("x\nFig. 3: Una curva\ny",), ("niente",)], "t string").select(media.caption(F.col("t")).alias("v")).collect()
    assert [r.v for r in caps] == ["Fig. 3: Una curva", None]
    pages = spark.createDataFrame([(1, "<path/>" * 501), (2, "<path/>" * 500)], "page int, svg string")
    assert [r.page for r in media.vector_pages(pages).collect()] == [1]


def words(rows):
    return [(1, 1, float(x0), float(y0), float(x0 + 6 * len(t) if w is None else x0 + w), float(y0 + h), t) for x0, y0, h, w, t in rows]


WORDS = "doc_id int, page int, x0 double, y0 double, x1 double, y1 double, txt string"


def test_tables_with_ragged_last_row(spark):
    prose = [(40 * i, 0, 10, 30, "parola") for i in range(30)]
    grid = [(100 * c, 20 + 12 * r, 10, 20, str(10 * r + c)) for r in range(3) for c in range(4)]
    tail = [(0, 56, 10, 20, "99"), (0, 70, 10, 60, "testo")]
    df = spark.createDataFrame(words(prose + grid + tail), WORDS)
    rows = geometry.table_rows(df).orderBy("line").collect()
    assert [r.is_table for r in rows] == [False, True, True, True, False, False]
    native = geometry.table_blocks(geometry.table_rows(df)).collect()
    assert [(r.first_line, r.n_lines, r.y0, r.y1) for r in native] == [(1, 3, 20.0, 54.0)]
    exact = [r for r in geometry.page_structure(df).collect() if r.kind == "table"]
    assert [(r.x0, r.y0, r.x1, r.y1) for r in exact] == [(0.0, 20.0, 320.0, 66.0)]


def test_formula_with_scripts(spark):
    line = [(0, 0, 10, 8, "s"), (9, -1, 6, 4, "2"), (20, 0, 10, 8, "="), (35, 0, 10, 8, "n"), (44, 7, 6, 4, "i"), (55, 0, 10, 8, "+"), (70, 0, 10, 8, "1")]
    prose = [(60 * i, 40, 10, 50, "prosa") for i in range(10)]
    got = [r.body for r in geometry.page_structure(spark.createDataFrame(words(line + prose), WORDS)).collect() if r.kind == "formula"]
    assert got == ["s^2 = n_i + 1"]


def squeezed(text):
    return "".join(text.split())


def test_chunks_cover_the_text():
    rng = random.Random(3)
    fence = "<!-- tabella pag 1 blocco 1 -->\n```\n" + "1 2 3\n" * 200 + "```"
    texts = ["parola " * 400, "# A\n" + "x. " * 300 + "\n# B\n" + "y. " * 300, "\n\n".join("frase. " * rng.randrange(5, 60) for _ in range(12)) + "\n\n" + fence + "\n\nfine", "z" * 5000, "", "<!-- pag 1 -->\n" + "a b c. " * 100 + "\n<!-- pag 2 -->\n" + "d e f. " * 100]
    for text in texts:
        parts, counts = chunking.chunked(text, 500)
        assert squeezed("".join(parts)) == squeezed(text)
        assert all(len(p) <= 500 or fence in p or " " not in p for p in parts)
        assert sum(p.count("```") % 2 for p in parts) == 0
        assert len(parts) == 1 or any(counts.values())
    assert chunking.budget() == 15417
    assert chunking.chunked("# A\n" + "x " * 200 + "\n# B\n" + "y " * 200, 500)[1]["titoli"] == 1


def test_chunk_columns(spark):
    df = spark.createDataFrame([("parola " * 400,), (None,), ("poco",)], "text string")
    got = df.select(chunking.chunks(F.col("text"), 500).alias("p")).collect()
    assert len(got[0].p.chunks) == 6 and got[1].p.chunks is None and got[2].p.chunks == ["poco"]
    total = chunking.coverage(df.where("text is not null").select("text", chunking.chunks(F.col("text"), 500).alias("parts"))).first()
    assert (total.n_sources, total.n_left_out, total.n_divided, total.n_chunks) == (2, 1, 1, 6)


def test_blocks(spark):
    text = "a <!-- formula pag 1 blocco 1 -->\n```\nx^2_i\n```\nb <!-- tabella pag 2 blocco 1 -->\n```\n1 2\n```"
    row = spark.createDataFrame([(text,)], "t string").select(chunking.for_model(F.col("t")).alias("m"), chunking.material(F.col("t")).alias("x"), chunking.placeholder_share(F.col("t")).alias("s"), *[c.alias(n) for n, c in chunking.block_counts(F.col("t")).items()]).first()
    assert row.m.count("riportata uguale") == 2 and row.x.startswith("**Formula**") and "**Tabella**" in row.x and 0 < row.s
    assert (row.n_tables, row.n_formulas, row.n_raised, row.n_lowered) == (1, 1, 1, 1)
    bullets = spark.createDataFrame([(["A", "b", "a", "c", "D", "e"],)], "b array<string>").select(chunking.merged_bullets(F.col("b")).alias("v")).first().v
    assert bullets == ["A", "b", "c", "D"]


def test_page_ranges(spark):
    pages = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 4, "d")], "doc_id int, page int, text string")
    ranges = spark.createDataFrame([(1, 0, 1, 2), (1, 1, 3, 4), (1, 2, 4, 9)], "doc_id int, section int, first int, last int")
    assert {r.section: r.source for r in chunking.page_range(pages, ranges).collect()} == {0: "a\nb", 1: "", 2: "d"}


def test_titles_are_no_sections(spark):
    body = "x" * 100
    rows = [(1, 0, 1, 20.0, "Titolo"), (1, 1, 1, 10.0, body), (1, 2, 1, 16.0, "Uno"), (1, 3, 1, 10.0, body), (1, 4, 2, 20.0, "Due"), (1, 5, 2, 10.0, body)]
    rows += [(2, 0, 1, 16.0, "Parte"), (2, 1, 1, 10.0, body), (2, 2, 2, 20.0, "Grande"), (2, 3, 2, 10.0, body)]
    found = structure.sections(spark.createDataFrame(rows, "doc_id int, seq int, page int, size double, text string")).collect()
    assert sorted((r.doc_id, r.title, r.is_title, r.kept, r.level) for r in found) == [
        (1, "Due", False, True, 1),
        (1, "Titolo", True, False, None),
        (1, "Uno", False, True, 2),
        (2, "Grande", False, True, 1),
        (2, "Parte", False, True, 2),
    ]


@pytest.mark.parametrize("most", [retrieval.MOST_ASKED, 0])
def test_overlap_and_bm25_however_many_queries(spark, monkeypatch, most):
    """The same rows with words that are broadcast and with joins by hash."""
    monkeypatch.setattr(retrieval, "MOST_ASKED", most)
    queries = spark.createDataFrame([(1, "gatto nero nero"), (2, "cane"), (3, "the of")], "query_id int, text string")
    docs = spark.createDataFrame([(1, "gatto gatto cane"), (2, "un gatto nero dorme"), (3, None), (4, "altro")], "doc_id int, text string")
    assert sorted((r.query_id, r.doc_id, r.shared) for r in retrieval.overlap(queries, docs).collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 1)]
    scores = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25(queries, docs, key="doc_id").collect()}
    assert set(scores) == {(1, 1), (1, 2), (2, 1)} and scores[1, 2] > scores[1, 1]


def test_words_of_a_sentence_are_cut_once(spark):
    said = spark.createDataFrame([(1, 1, "user", "Ho fame. Vado via.")], "conv_id int, turn int, role string, text string")
    plan = facts.facts(said)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 3


def test_tables_are_released(spark, tmp_path, monkeypatch):
    from marlstone import session

    with monkeypatch.context() as patch:
        patch.setattr(session, "_own_folder", lambda _: str(tmp_path))
        session.stored(spark.range(3)).count()
        assert len(list(tmp_path.iterdir())) == 1
        session.release(spark)
        assert not list(tmp_path.iterdir())

    class Cluster:
        conf = type("Conf", (), {"get": lambda self, key, default=None: default})()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Cluster, "table")
