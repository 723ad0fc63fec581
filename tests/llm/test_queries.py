"""The queries, on small tables: against the SQL where there is some, else against brute force."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from test_sets import brute_classes, brute_verdict, corpus
from test_texts import LICENCES, SECRETS, base_counts, brute_cost, brute_spans, library_ids, made

import corpus_pipeline
from marlstone.llm import licences, neardup, ppm, quality, queries, secrets

LANGS = {"en": "the house and the garden of the old town with a stone wall", "de": "das alte Haus und der Garten an der Straße mit einer Mauer", "fr": "la vieille maison et le jardin près de la rue avec un été"}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of tables, and the documents by id."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(6)
    texts, langs = [], []
    for i in range(90):
        lang = list(LANGS)[i % 3]
        words = LANGS[lang].split()
        texts.append(" ".join(rng.choice(words) for _ in range(int(rng.integers(60, 160)))) + (".\n" if i % 2 else ""))
        langs.append(lang)
    extra = [*made(2, 8), *SECRETS, *LICENCES, *[t for t in corpus() if t][:12], texts[0], texts[0] + " again", "%%% " + " ".join(w + "%%%" for w in texts[3].split()), None]
    texts += extra
    langs += [None] * len(extra)
    docs = list(enumerate(texts))
    spark.createDataFrame([(i, t, lang, "src", len(t or "")) for (i, t), lang in zip(docs, langs, strict=True)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    urls = ["http://A.example.net/en/x", "https://example.com/de/?q", "http://x.org/fr/", "no", None, "http://net/", "http://net"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(i, [float(x) for x in rng.normal(size=64)]) for i in range(40)], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return folder, dict(docs), dict(zip(range(len(texts)), langs, strict=True))


def rows_of(spark, name, folder):
    return {r[0]: r for r in queries.queries()[name](spark, folder).collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables[0]}/{t}.parquet/*.parquet'")
    ours, theirs = queries.queries()[name](spark, tables[0]).toArrow(), con.sql(queries.oracle_sql()[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    assert sorted(map(repr, ours.select(sorted(ours.column_names)).to_pylist())) == sorted(map(repr, theirs.select(sorted(theirs.column_names)).to_pylist()))


def test_url_filter(spark, tables):

    found = rows_of(spark, "op6_url_filter", tables[0])
    assert [found[i].verdict for i in range(7)] == ["allow", "block", "allow", "allow", "allow", "block", "allow"]
    assert found[0].rule == "example.net/en/" and found[6].rule is None and brute_verdict("http://net")[3] == "allow"


def brute_scores(docs, target_ids):
    def grams(text):
        data = (text or "").encode()
        return [(n, data[i : i + n]) for n in quality.GRAMS for i in range(len(data) - n + 1)]

    from collections import Counter

    def bucket(n, gram):
        value = n
        for c in gram:
            value = (value * 0x9E3779B97F4A7C15 + c + 1) % 2**64
        return ((((value ^ value >> 31) * 0xBF58476D1CE4E5B9) % 2**64) >> 33) % quality.BUCKETS

    memo = {}
    by_doc = {i: [memo.setdefault(g, bucket(*g)) for g in grams(t)] for i, t in docs.items()}
    raw, target = Counter(), Counter()
    for i, own in by_doc.items():
        raw.update(own)
        if i in target_ids:
            target.update(own)
    share = target.total() / raw.total()
    ratio = {b: np.log(target[b] + quality.PRIOR) - np.log(n * share + quality.PRIOR) for b, n in raw.items()}
    return {i: float(np.mean([ratio[b] for b in own])) if own else 0.0 for i, own in by_doc.items()}


def test_quality_rules(spark, tables):
    folder, docs, _ = tables
    found, scores = rows_of(spark, "op1_quality_rules", folder), brute_scores(docs, set(range(60)))
    assert set(found) == set(docs)
    for i, t in docs.items():
        r, counts = found[i], base_counts(t or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert r.base_failed == failed and r.score == pytest.approx(scores[i]) and r.kept == (not failed and scores[i] >= quality.LEAST)
    junk = next(i for i, t in docs.items() if t and t.startswith("%%%"))
    assert not found[junk].kept and all(found[i].kept for i in range(90) if not found[i].base_failed)


def test_near_duplicates(spark, tables):
    folder, docs, _ = tables
    expected = brute_classes([docs[i] for i in sorted(docs)])
    assert {i: r.class_id for i, r in rows_of(spark, "op2_near_duplicates", folder).items()} == expected


def test_image_copies(spark, tables):
    rows = queries.queries()["op3_image_copies"](spark, tables[0]).collect()
    assert len(rows) == 42 and sum(r.edited for r in rows) == 2
    assert all(r.class_id == r.vec_id for r in rows)


def test_byte_bpe(spark, tables):
    folder, docs, _ = tables
    found = rows_of(spark, "op4_byte_bpe", folder)
    for (i, t), ids in zip(docs.items(), library_ids("byte_bpe_50k.json", docs.values()), strict=True):
        assert (found[i].n_tokens, found[i].ids_sha256, found[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_language_id(spark, tables):
    folder, docs, langs = tables
    found = rows_of(spark, "op5_language_id", folder)
    learned = {lang: sorted({docs[i] for i in docs if langs[i] == lang and zlib.crc32(str(i).encode()) % 5}) for lang in LANGS}
    for i, t in list(docs.items())[:4] + list(docs.items())[90:110]:
        assert found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        if not t or not re.search(r"[^\W\d_]", t):
            assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
        elif len(t) < 400:
            costs = {lang: brute_cost(learned[lang], t, ppm.ORDER) for lang in LANGS}
            best = min(costs, key=costs.get)
            if sorted(costs.values())[1] - costs[best] > 1:
                assert found[i].lang_pred == best
    assert all(found[i].lang_pred == langs[i] and 0 < found[i].score <= 1 for i in range(90))


def test_token_files(spark, tables):
    folder, docs, _ = tables
    found, start = rows_of(spark, "op8_token_files", folder), 0
    for i, ids in zip(sorted(docs), library_ids("byte_bpe_50k.json", [docs[i] for i in sorted(docs)]), strict=True):
        ids = [*ids, 0]
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def pieces_of(docs):
    out = {}
    for i, ids in zip(docs, library_ids("word_bpe_49k.json", docs.values()), strict=True):
        ids = [*ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            out[i, k // 2048] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    return out


def check_packed(rows, docs):
    expected = pieces_of(docs)
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == expected and len(rows) == len(expected)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [at for at, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048
    return len(bins)


def test_packing(spark, tables):
    folder, docs, _ = tables
    n = check_packed(queries.queries()["op9_best_two_fit"](spark, folder).collect(), docs)
    assert n <= 1 + -(-sum(length for _, length, _ in pieces_of(docs).values()) // 2048)


def test_licence_scan(spark, tables):
    folder, docs, _ = tables
    found = rows_of(spark, "op10_licence_scan", folder)
    for i, t in docs.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(k, label) for p, label in licences.BASE_PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in places]
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        base = sorted({label for _, label in places})
        assert r.base_labels == ",".join(base) and set(base) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    tagged = next(i for i, t in docs.items() if t and t.startswith("// SPDX"))
    assert found[tagged].labels == "apache-2.0,gpl-2.0,mit"


def test_pipeline(spark, tables):
    """All stages against plain loops over all documents."""
    folder, docs, langs = tables
    scores = brute_scores(docs, set(range(60)))
    kept = {i: t for i, t in docs.items() if t and (c := base_counts(t))[0] >= 50 and 100 * c[4] <= 50 * c[0] and scores[i] >= quality.LEAST}
    learned = {lang: sorted({kept[i] for i in kept if langs[i] == lang and zlib.crc32(str(i).encode()) % 5}) for lang in LANGS}
    sure = {}
    for i, t in kept.items():
        bits = np.array([brute_cost(own, t, ppm.ORDER) for own in learned.values()]) if len(t) < 3000 else np.zeros(3)
        sure[i] = bool(re.search(r"[^\W\d_]", t)) and (len(t) >= 3000 or 1 / np.exp2((bits.min() - bits) * min(1, ppm.SPAN / len(t.encode()))).sum() >= 0.5)
    kept = {i: t for i, t in kept.items() if sure[i]}
    ids = sorted(kept)
    classes = brute_classes([kept[i] for i in ids])
    kept = {i: kept[i] for n, i in enumerate(ids) if classes[n] == n}
    for i, t in kept.items():
        out, at = "", 0
        for start, _, end in brute_spans(t, secrets.RULES):
            if start >= at:
                out += t[at:start] + "[secret]"
            at = max(at, end)
        kept[i] = out + t[at:]
    check_packed(corpus_pipeline.run(spark, folder).collect(), kept)
    assert len(neardup.words_of(docs[0])) > 50 and len(kept) > 80
