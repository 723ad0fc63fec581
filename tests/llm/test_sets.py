"""Operators on sets of rows: near-duplicates, image copies, url rules; and the pipeline."""

import random

import numpy as np
import pytest

import corpus_pipeline
from marlstone.llm import imagecopies, neardup, urlfilter

EMPTY = "doc_id long, text string, lang string"


def classes_of(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def edited(rng, words, share):
    return [w if rng.random() > share else w + "x" for w in words]


def corpus():
    """Groups of near copies of different closeness, copies, short, blank and null texts."""
    rng = random.Random(4)
    texts = []
    for size in (2, 3, 5, 40):
        words = [f"w{rng.randrange(500)}" for _ in range(120)]
        texts.append(" ".join(words))
        texts += [" ".join(edited(rng, words, rng.choice([0.005, 0.01, 0.02, 0.05]))) for _ in range(size)]
    texts += [texts[0], texts[0].upper() + "!", "one two", "One, two.", "one", "", " .. ", None, "a b a b a b a b a b " * 30, "a b a b a b a b a b " * 31, "a b a b a b a b a b " * 60]
    texts += [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(3, 200))) for _ in range(30)]
    return texts


def brute_classes(texts):
    bags = [neardup.bag_of(t) if t and neardup.words_of(t) else None for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if bags[i] and bags[j] and neardup.similarity(bags[i], bags[j]) >= 0.8]
    return classes_of(links, range(len(texts)))


@pytest.mark.parametrize("small", [neardup.SMALL, 1])
def test_near_duplicates_by_brute_force(spark, monkeypatch, small):
    """Also with blocks for every bucket, and blocks of a few nodes."""
    monkeypatch.setattr(neardup, "SMALL", small)
    if small == 1:
        monkeypatch.setattr(neardup, "BLOCK", 8)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    rows = neardup.near_duplicates(docs, keep=("node", "text")).collect()
    expected = brute_classes(texts)
    assert {r.doc_id: r.class_id for r in rows} == expected
    sizes = {c: list(expected.values()).count(c) for c in expected.values()}
    assert all(r.class_size == sizes[r.class_id] and r.representative == (r.doc_id == r.class_id) and r.node == "k" and r.text == texts[r.doc_id] for r in rows)


def test_repeated_rows_and_null_ids(spark):
    text = "the same words over and over again in one text"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, "another text that nobody else has at all"), (None, None), (None, None)], "doc_id long, text string")
    rows = neardup.near_duplicates(docs).collect()
    assert len(rows) == 6 and sum(r.representative for r in rows) == 4
    assert sorted((r.class_id is None, r.class_size) for r in rows) == [(False, 3)] * 3 + [(True, 1)] * 3
    assert neardup.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0


def test_near_duplicates_of_very_long_texts(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(50_000)}" for _ in range(400_000)]
    other = list(words)
    for i in range(0, len(other), 200):  # five shingles of 200 differ
        other[i] += "x"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words)), (4, " ".join(words[:200_000])), (5, "y" * 3_000_000)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for trial in range(30):
        a = rng.integers(0, 9, 50)
        b = np.where(rng.random(50) < 0.6, a, rng.integers(0, 9, 50))
        element = neardup.mixed(np.arange(50).astype(np.uint64) + np.uint64(1000 * trial))
        doc = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        times = neardup.bag_min_hash(doc, np.concatenate([element[a > 0], element[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 1024)
        errors.append((times[0] == times[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (102, 100)] + [(200, i) for i in range(201, 260)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.root for r in neardup.components(df).collect()}
    expected = classes_of(links, {n for link in links for n in link})
    assert found == expected
    assert neardup.components(df.where("a < 0")).count() == 0


RULES = "SELECT * FROM VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'), ('block', 'a.b.example.net', ''), ('allow', 'EXAMPLE.net', '/en/'), ('block', CAST(NULL AS STRING), '/'), ('block', 'deep.org', CAST(NULL AS STRING)) AS t(verdict, host, path)"
RULE_ROWS = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "a.b.example.net", ""), ("block", "deep.org", "")]


def brute_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?", 1)[0].split("#", 1)[0]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in RULE_ROWS if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, 0, False, None, "allow")
    return host, path, best[3], best[4]


def test_url_rules_by_brute_force(spark):
    rng = random.Random(1)
    hosts = ["net", "NET", "xnet", "example.net", "www.example.net", "a.b.example.net", "z.a.b.example.net", "example.com", "notexample.com", "org", "fr.org", "deep.org", "x.deep.org", "", "a..net", "net.", "é.net", "example.net:80", "[::1]"]
    urls = [f"{rng.choice(['http', 'https', 'x'])}://{h}{p}" for h in hosts for p in ("", "/", "/en/", "/en", "/en/x?y#z", "/de/1", "/fr/", "?q=/en/", "#/en/", "/x\n/y")] + [None, "", "net/", "http:/net/", "a://b://net/", "://net/"]
    rows = [(i, u, "clash", "clash", "clash") for i, u in enumerate(urls)] + [(None, urls[0], "", "", ""), (0, urls[0], "", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, key string, rule string")
    for group in (urlfilter.GROUP, 3):
        found = urlfilter.judge_urls(pages, spark.sql(RULES), group=group).collect()
        assert len(found) == len(rows)
        for r in found:
            assert (r.host, r.path, r.rule, r.verdict) == brute_verdict(urls[r.page_id or 0]), urls[r.page_id or 0]
    no_rules = spark.sql(RULES).where("host = 'none'")
    assert {r.verdict for r in urlfilter.judge_urls(pages, no_rules, default="block").collect()} == {"block"}
    assert urlfilter.judge_urls(pages.where("page_id < 0"), spark.sql(RULES)).count() == 0


def test_nested_paths_of_a_hot_host(spark):
    """Many nested rules of one host: the longest prefix wins, in groups of any size; very long urls too."""
    rng = random.Random(2)
    paths = ["", "/", *("/" + "a" * n + t for n in range(1, 12) for t in ("", "/", "b")), "/é", "/a" + chr(0xFFFF), "/" + "x" * 50_000]
    rules = [(rng.choice(["allow", "block"]), rng.choice(["hot.net", "net", "x.hot.net"]), p) for p in paths for _ in range(2)]
    urls = [f"http://{h}{p}{t}" for h in ("hot.net", "x.hot.net", "y.hot.net", "net") for p in paths for t in ("", "a", "/z", chr(0xFFFF))] + ["http://" + "a." * 20_000 + "hot.net/aa/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    known = spark.createDataFrame(rules, "verdict string, host string, path string")

    def best(url):
        host, _, path = url.removeprefix("http://").partition("/")
        path = "/" + path if url.count("/") > 2 else ""
        host, path = (url.removeprefix("http://"), "") if not path else (host, path)
        fits = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[3:] if fits else (None, "allow")

    for group in (urlfilter.GROUP, 5):
        found = urlfilter.judge_urls(pages, known, group=group).collect()
        assert len(found) == len(urls) and all((r.rule, r.verdict) == best(urls[r.page_id]) for r in found)


def test_met_evenly_parts_large_keys(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(["hot"] * 30 + ["b", "c", "d"] + [None])], "k string, i int")
    facts = spark.createDataFrame([("hot", 1), ("b", 2), ("e", 3)], "k string, v int")
    for parts in (2, 1000):
        found = sorted((r.i, r.k, r.v) for r in neardup.met_evenly(rows, facts, "k", parts).collect())
        assert [v for _, _, v in found] == [1] * 30 + [2, None, None, None] and len(found) == 34


def test_image_copies_are_found(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(60, 64))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(60, None), (61, [])]
    media = imagecopies.drawn_media(spark.createDataFrame(rows, "vec_id int, embedding array<double>"), copies=2)
    found = imagecopies.image_copies(media, id_col="vec_id", media_col="media", keep=("edited",)).collect()
    assert len(found) == 62 + 30  # vectors without values have no picture, so no copy either
    copies = [r for r in found if r.edited]
    assert np.mean([r.class_size > 1 and r.class_id == r.vec_id for r in copies]) >= 0.9
    plain = {r.vec_id: r for r in found if not r.edited}
    assert all(r.class_id == i and r.class_size <= 2 for i, r in plain.items())


def test_image_defined_cases(spark):
    image = imagecopies.encode_pgm(imagecopies.drawn(np.random.default_rng(5).normal(size=(1, 64)))[0])
    colour = b"P6\n# c\n2 1\n255\n" + bytes([0, 3, 6, 255, 255, 255])
    assert imagecopies.decode_pnm(colour).tolist() == [[3.0, 255.0]]
    rows = [(1, image), (1, image), (2, None), (3, b""), (4, b"P5 9 9 255\nx"), (5, imagecopies.encode_pgm(np.full((80, 80), 9.0))), (6, colour), (None, image)]
    found = imagecopies.image_copies(spark.createDataFrame(rows, "id long, media binary"), id_col="id", media_col="media").collect()
    assert sorted((r.id or 0, r.class_id, r.class_size) for r in found) == [(0, 1, 3), (1, 1, 3), (1, 1, 3), (2, 2, 1), (3, 3, 1), (4, 4, 1), (5, 5, 1), (6, 6, 1)]
    none = spark.createDataFrame([], "id long, media binary")
    assert imagecopies.image_copies(none, id_col="id", media_col="media").count() == 0


def brute_image_classes(images, inliers=imagecopies.INLIERS):
    """The smallest number of each image's class, by all pairs of corners of all pairs of images."""
    corners = []
    for image in images:
        d = imagecopies.describe(np.rint(image)[None])
        corners.append(d | {"tables": d["bits"].copy().view("<i4"), "wide": np.unpackbits(d["bits"], axis=1)})
    root = list(range(len(images)))
    for a, x in enumerate(corners):
        for b, y in list(enumerate(corners))[a + 1 :]:
            near = (x["tables"][:, None] == y["tables"][None]).any(axis=2) & ((x["wide"][:, None] != y["wide"][None]).sum(axis=2) <= imagecopies.DISTANCE)
            votes = {}
            for i, j in zip(*np.nonzero(near), strict=True):
                turn, grow = (y["turn"][j] - x["turn"][i]) % (2 * np.pi), int(y["scale"][j] - x["scale"][i])
                size = (imagecopies.SCALES[0] / imagecopies.SCALES[1]) ** grow
                dy = y["y"][j] - size * (x["y"][i] * np.cos(turn) + x["x"][i] * np.sin(turn))
                dx = y["x"][j] - size * (x["x"][i] * np.cos(turn) - x["y"][i] * np.sin(turn))
                for half in np.ndindex(2, 2, 2):
                    cell = (half, grow, int(np.floor(dy / 16 + half[0] / 2)), int(np.floor(dx / 16 + half[1] / 2)), int(np.floor((turn * 12 / (2 * np.pi) + half[2] / 2) % 12)))
                    votes.setdefault(cell, set()).add((np.floor(x["y"][i] / 2 + 0.5), np.floor(x["x"][i] / 2 + 0.5)))
            if any(len(v) >= inliers for v in votes.values()):
                root = [root[a] if r == root[b] else r for r in root]
    return [root.index(r) for r in root]


@pytest.mark.parametrize(("small", "block"), [(16, 1024), (2, 5)])
def test_copies_meet_beyond_a_buckets_first_image(spark, monkeypatch, small, block):
    # images of one frame, of which the first is of no other's kind
    monkeypatch.setattr(imagecopies, "SMALL", small)
    monkeypatch.setattr(imagecopies, "BLOCK", block)
    rng = np.random.default_rng(3)
    stamp = imagecopies.drawn(rng.normal(size=(1, 64)), 40)[0]
    kinds = imagecopies.drawn(rng.normal(size=(12, 64)))
    images = []
    for k in [0, *range(1, 12), *range(1, 12)]:
        image = np.zeros((100, 140))
        image[10:90, 10:90] = kinds[k]
        image[30:70, 95:135] = stamp
        images.append(np.clip(image * (1 if len(images) < 12 else 0.9), 0, 255))
    media = spark.createDataFrame([(i, imagecopies.encode_pgm(x)) for i, x in enumerate(images)], "id long, media binary").coalesce(1)
    for inliers in (4, 12, 24):
        found = {r.id: r for r in imagecopies.image_copies(media, id_col="id", media_col="media", inliers=inliers).collect()}
        expected = brute_image_classes(images, inliers)
        assert [found[i].class_id for i in range(len(images))] == expected
        assert all(found[i].class_size == expected.count(expected[i]) and found[i].representative == (i == expected[i]) for i in found)


def pipeline_docs(spark):
    rng = random.Random(8)
    clean = [" ".join(rng.choice("the and of in house garden river stone walks over under light grey morning evening".split()) for _ in range(120)) for _ in range(25)]
    texts = clean + [clean[0], clean[0] + " end", "too short", "junk%%% " * 80, None, "", clean[1] + ' password = "abcdefgh12345"', "12 34 !! " * 60]
    return texts, spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_pipeline_stage_by_stage(spark, tmp_path):
    texts, docs = pipeline_docs(spark)
    spark.createDataFrame([(i, 1, 0) for i in range(25)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        rows = docs.collect()
        seen.append({r.doc_id for r in rows})
        if name != "best_two_fit":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "secret_scan":
            masked = [r for r in rows if "[secret]" in r.text]
            assert {r.doc_id for r in masked} <= {1, 31} and all(r.n_chars == len(r.text) and "abcdefgh" not in r.text for r in rows)
    assert set(range(25)) <= seen[0] and not seen[0] & {27, 28, 29, 30}
    assert seen[1] >= set(range(25)) and seen[2] & {0, 25, 26} == {0}
    assert seen[2] == seen[3] == seen[4]
    assert len({(r.doc_id, r.piece) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}) == len(seen[4])


def test_stages_keep_clashing_columns_and_repeated_ids(spark, tmp_path):
    """Extra columns named as what the operators make come through; rows of one id, or none, are rows."""
    names = ["row", "node", "keys", "sig", "root", "class_id", "representative", "masked", "spans", "key", "kept", "base_failed", "lang_pred", "id", "piece", "_text", "_id", "found"]
    texts, docs = pipeline_docs(spark)
    rows = [(0 if i in (3, 4) else None if i == 5 else i, t, "en", "src", len(t or ""), *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    kinds = ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {kinds}")
    spark.createDataFrame([(i, 1, 0) for i in range(25)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
    held = docs.collect()
    assert sorted(r.row for r in held if not r.doc_id) == ["row0", "row3", "row4", "row5"]
    assert all(r[n] == f"{n}{r.row[3:]}" for r in held for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(held)


def test_stages_take_empty_tables(spark, tmp_path):
    docs = pipeline_docs(spark)[1].where("doc_id < 0")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
