"""Queries over rows that are stated here, for rules whose cases no table holds: Italian sentences of
every kind, notes with front matter, listings of PDF tools, event streams, permissions. The
same rows are the tables of each query's SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import lexicons
from marlstone.functions import text as tx
from marlstone.operators import chunking, facts, geometry, media, notes, retrieval, structure
from marlstone.plans.catalogue import register
from marlstone.plans.conversation_queries import _QUOTE_FORM, SENTENCES
from marlstone.sources import readers
from marlstone.streaming import supervision

_SQL_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}


@dataclass(frozen=True)
class Rows:
    """Rows of a stated schema, as a DataFrame and as SQL."""

    schema: str
    rows: tuple[tuple, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    def sql(self) -> str:
        names, kinds = zip(*(f.split() for f in self.schema.split(", ")), strict=True)
        values = ", ".join("(" + ", ".join(f"{_literal(v)}::{_SQL_TYPES[k]}" for v, k in zip(row, kinds, strict=True)) + ")" for row in self.rows)
        return f"(SELECT * FROM (VALUES {values}) AS t({', '.join(names)}))"


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_literal, value)) + "]"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else repr(value)


def sample(name: str, rows: dict[str, Rows], sql: str) -> Callable:
    """Registers a function of one DataFrame for each of ``rows``, which are the tables of ``sql``."""
    tables = ", ".join(f"{n} AS {r.sql()}" for n, r in rows.items())

    def add(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        register(name, f"WITH {tables}{', ' if sql.startswith('AND ') else ' '}{sql.removeprefix('AND ')}")(lambda spark, sf_dir: query(*(r.frame(spark) for r in rows.values())))
        return query

    return add


SAID = Rows(
    "conv_id bigint, turn int, role string, text string",
    (
        (1, 1, "user", "Ho deciso di partire. Mi piace il mare! La casa è grande. Come stai?"),
        (1, 2, "assistant", "Io sono un programma."),
        (1, 3, "user", "Fammi una lista; dimmi l'ora. Ora scrivi tutto. Puoi aiutarmi."),
        (2, 1, "user", "Tu sei gentile. Non riesci a capire. Ciao. Questo ti serve."),
        (2, 2, "user", "[foto: gatto.jpg]\nIl dott. Rossi abita a Roma. Costa 3.50 euro, ecc. e basta.\n\n[audio: x]"),
        (3, 1, "user", None),
        (3, 2, "user", "   \n  "),
        (3, 3, "user", "Noi andiamo al cinema:  poi torniamo... vero?! Sì."),
        (4, 1, "user", "Mi serve un cavo. Ieri pioveva. Domani vado via. Hai ragione tu. Mi fai un caffè. Uso Linux ogni giorno. prima guarda bene."),
        (4, 2, "user", "Nulla da dire sul tempo. Ok."),
    ),
)


@sample("fact_rules", {"conversations": SAID}, f"AND {SENTENCES.strip()} SELECT conv_id, turn, seq, sentence, reason, kind FROM facts")
def fact_rules(said: DataFrame) -> DataFrame:
    """Sentences of every kind that can occur."""
    return facts.facts(said).select("conv_id", "turn", "seq", "sentence", "reason", "kind")


@sample("blank_filtered_messages", {"m": SAID}, "SELECT conv_id, turn, trim(text) AS text FROM m WHERE trim(coalesce(text, '')) <> ''")
def blank_filtered_messages(said: DataFrame) -> DataFrame:
    """S1'. Only spaces are trimmed, as by the SQL."""
    return readers.said(said).select("conv_id", "turn", "text")


TEXTS = Rows(
    "id bigint, text string",
    (
        (1, "L'Acqua, bolle a 100°C!  Sì: \"vero\"... e-mail\tper me"),
        (2, ""),
        (3, "<think>uno due</think>\n La risposta è 42. "),
        (4, "<think>senza fine"),
        (5, "prima</think>dopo</think>ultimo"),
        (6, "riga uno\n[Home](/a) [Chi siamo](/b)\n\n\n![logo](/x.png)\n%PAGINA% [a](b)\nTesto [con](/link) parole\n   \nfine"),
        (7, "già   PRONTO -- _sì_"),
        (8, "riga\n" * 500),
        (9, "parola " * 400),
        (10, "x" * 1200 + "\n" + "y" * 1000),
    ),
)


@sample("match_forms", {"t": TEXTS}, r"SELECT id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s'']', ' ', 'g'), '\s+', ' ', 'g')) AS form FROM t")
def match_forms(texts: DataFrame) -> DataFrame:
    """F3."""
    return texts.select("id", tx.match_form(F.col("text")).alias("form"))


@sample("thinking_removed", {"t": TEXTS}, "SELECT id, trim(CASE WHEN contains(text, '</think>') THEN text[strpos(text, '</think>') + 8:] WHEN starts_with(text, '<think>') THEN '' ELSE text END) AS body FROM t")
def thinking_removed(texts: DataFrame) -> DataFrame:
    """F20."""
    return texts.select("id", tx.without_thinking(F.col("text")).alias("body"))


@sample(
    "line_cuts",
    {"t": TEXTS},
    r"""AND h AS (SELECT id, text, text[1:1600] AS head FROM t), e AS (SELECT *, length(head) - strpos(reverse(head), chr(10)) AS last FROM h)
    SELECT id, CASE WHEN length(text) <= 1600 THEN text ELSE rtrim(CASE WHEN contains(head, chr(10)) AND last > 960 THEN head[1:last] ELSE head END) || chr(10) || '[...]' END AS cut FROM e""",
)
def line_cuts(texts: DataFrame) -> DataFrame:
    """T9."""
    return texts.select("id", tx.line_cut(F.col("text")).alias("cut"))


_LINK = r"!?\[(?:[^\]\[]|\[[^\]]*\])*\]\([^)]*\)"


@sample(
    "navigation_removed",
    {"t": TEXTS},
    rf"""SELECT id, trim(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND regexp_matches(regexp_replace(regexp_replace(x, '{_LINK}', ' ', 'g'), '%[^\s%]+%', ' ', 'g'), '[\p{{L}}\p{{N}}_]')), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')) AS body FROM t""",
)
def navigation_removed(texts: DataFrame) -> DataFrame:
    """F16, P10."""
    return texts.select("id", tx.without_navigation(F.col("text")).alias("body"))


NAMES = Rows("id bigint, stem string", ((1, "lezione-03_analisi"), (2, "FISICA-II"), (3, "note"), (4, "l_acqua--calda"), (5, "42"), (6, "ABC_def")))


@sample(
    "document_labels",
    {"n": NAMES},
    r"""AND p AS (SELECT id, trim(regexp_replace(stem, '[-_]+', ' ', 'g')) AS s FROM n)
    SELECT id, CASE WHEN s = upper(s) AND s <> lower(s) THEN s ELSE array_to_string(list_transform(string_split(s, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') END AS label FROM p""",
)
def document_labels(names: DataFrame) -> DataFrame:
    """F18."""
    return names.select("id", tx.label_form(F.col("stem")).alias("label"))


SECONDS = Rows("id bigint, s double", ((1, 0.0), (2, 59.9), (3, 60.0), (4, 3599.0), (5, 3600.0), (6, 86399.5), (7, 86400.0), (8, 1e6)))


@sample("durations", {"d": SECONDS}, "SELECT id, CASE WHEN floor(s) < 60 THEN floor(s)::BIGINT || 's' WHEN floor(s) < 3600 THEN floor(s)::BIGINT // 60 || 'm' WHEN floor(s) < 86400 THEN floor(s)::BIGINT // 3600 || 'h' ELSE floor(s)::BIGINT // 86400 || 'g' END AS told FROM d")
def durations(seconds: DataFrame) -> DataFrame:
    """F23."""
    return seconds.select("id", tx.duration(F.col("s")).alias("told"))


DAYS = Rows("id bigint, day string", ((1, "2024-01-31"), (2, "2023-12-01"), (3, "2024-02-29"), (4, None)))


@sample("italian_dates", {"d": DAYS}, "SELECT id, day(day::DATE) || ' ' || ['gennaio', 'febbraio', 'marzo', 'aprile', 'maggio', 'giugno', 'luglio', 'agosto', 'settembre', 'ottobre', 'novembre', 'dicembre'][month(day::DATE)] || ' ' || year(day::DATE) AS told FROM d WHERE day IS NOT NULL")
def italian_dates(days: DataFrame) -> DataFrame:
    """F26."""
    return days.where("day is not null").select("id", tx.italian_date(F.col("day").cast("date")).alias("told"))


OBSERVED = Rows("id bigint, line string", ((1, '- dice "mi piace il mare" e "vado via"'), (2, "- EXPLICIT: ama i gatti"), (3, "senza nulla"), (4, "- "), (5, 'vuote "" qui'), (6, "")))


@sample(
    "observed_quotes",
    {"o": OBSERVED},
    r"""AND i AS (SELECT id, list_filter(regexp_extract_all(line, '"([^"]+)"', 1), lambda q: q <> '') AS qs, trim(regexp_replace(regexp_replace(line, '^- ', ''), '^EXPLICIT:', '')) AS bare FROM o)
    SELECT id, array_to_string(CASE WHEN len(qs) > 0 THEN qs WHEN bare <> '' THEN [bare] ELSE [] END, '|') AS quotes FROM i""",
)
def observed_quotes(observed: DataFrame) -> DataFrame:
    """F7."""
    return observed.select("id", F.array_join(facts.quotes(F.col("line")), "|").alias("quotes"))


NOTES = Rows(
    "path string, text string",
    (
        ("a.md", '---\ntipo: nota-sezione\nsezione: 3\ntitolo: "Il \\"moto\\""\npagina: 12\npagina_fine: 15\n---\n\n# Moto\n'),
        ("b.md", "---\nsezione: 4\npagina: 16\ntags:\n  - fisica\n- altro: no\n---\ntesto"),
        ("c.md", "senza intestazione\nsezione: 9\npagina: 1"),
        ("d.md", "---\nsezione: x\npagina: 2\n---\n"),
        ("e.md", "---\nsezione: 5\nsezione: 6\npagina: 7\ntitolo: Calore: appunti\n---\n"),
    ),
)
_FRONT = r"""f AS (SELECT path, list_filter(string_split(regexp_extract(text, '(?s)^---\n(.*?)\n---', 1), chr(10)), lambda x: contains(x, ':') AND NOT starts_with(x, ' ') AND NOT starts_with(x, '-')) AS ls FROM n),
kv AS (SELECT path, i, trim(l[1:strpos(l, ':') - 1]) AS k, trim(l[strpos(l, ':') + 1:]) AS v FROM (SELECT path, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM f)),
lastkv AS (SELECT path, k, arg_max(v, i) AS v FROM kv GROUP BY path, k)"""


@sample("front_matter_fields", {"n": NOTES}, f"AND {_FRONT} SELECT path, k AS key, v AS value FROM lastkv")
def front_matter_fields(found: DataFrame) -> DataFrame:
    """S18."""
    return found.select("path", F.explode(readers.front_matter(F.col("text"))).alias("key", "value"))


@sample(
    "section_note_scan",
    {"n": NOTES},
    rf"""AND {_FRONT}, w AS (SELECT path, max(v) FILTER (WHERE k = 'sezione') AS s, coalesce(max(v) FILTER (WHERE k = 'titolo'), '""') AS t, max(v) FILTER (WHERE k = 'pagina') AS p, max(v) FILTER (WHERE k = 'pagina_fine') AS e FROM lastkv GROUP BY path)
    SELECT path, try_cast(s AS INTEGER) AS section, replace(trim(t, '"'), '\"', '"') AS title, try_cast(p AS INTEGER) AS page, coalesce(try_cast(e AS INTEGER), try_cast(p AS INTEGER)) AS page_end FROM w WHERE try_cast(s AS INTEGER) IS NOT NULL AND try_cast(p AS INTEGER) IS NOT NULL""",
)
def section_note_scan(found: DataFrame) -> DataFrame:
    """S19."""
    return readers.section_notes(found)


OBSERVATIONS = Rows(
    "id bigint, text string",
    (
        (1, "# Nota\n- fuori\n## Fatti\n- primo\n  - secondo \ntesto\n- terzo\n## Altro\n- fuori"),
        (2, "## Osservazioni\n- uno\n## Fatti\n- due"),
        (3, "nulla\n- qui"),
        (4, "## Fatti\r\n- a\r\n- b"),
    ),
)


@sample(
    "bullet_lines",
    {"o": OBSERVATIONS},
    r"""AND l AS (SELECT id, list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: trim(x)) AS ls FROM o),
    e AS (SELECT id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM l),
    a AS (SELECT id, min(i) AS first FROM e WHERE x IN ('## Fatti', '## Osservazioni') GROUP BY id),
    z AS (SELECT e.id, min(i) AS last FROM e JOIN a ON a.id = e.id AND i > first WHERE starts_with(x, '#') GROUP BY e.id)
    SELECT e.id, i - first AS place, trim(x[3:]) AS bullet FROM e JOIN a USING (id) LEFT JOIN z USING (id) WHERE i > first AND i < coalesce(last, 1000000) AND starts_with(x, '- ')""",
)
def bullet_lines(found: DataFrame) -> DataFrame:
    """S16. place: lines behind the heading."""
    held = found.select("id", F.explode(readers.bullets(F.col("text"))).alias("bullet"), "text")
    lines = F.transform(F.split("text", r"\r\n|\r|\n"), lambda x: F.trim(x))
    head = F.array_min(F.array_compact(F.array(*[F.nullif(F.array_position(lines, F.lit(h)), F.lit(0)) for h in ("## Fatti", "## Osservazioni")])))
    return held.select("id", (F.array_position(lines, F.concat(F.lit("- "), F.col("bullet"))) - head).alias("place"), "bullet")


SETTINGS = Rows("id bigint, text string", ((1, "# commento\nA=1\n B = due \nC\n\nA=3=4\n#D=5"), (2, ""), (3, "X=\nY=a b")))


@sample(
    "settings_lines",
    {"s": SETTINGS},
    r"""AND l AS (SELECT id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: NOT starts_with(x, '#') AND contains(x, '=')) AS ls FROM s),
    kv AS (SELECT id, i, trim(x[1:strpos(x, '=') - 1]) AS key, trim(x[strpos(x, '=') + 1:]) AS value FROM (SELECT id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM l))
    SELECT id, key, arg_max(value, i) AS value FROM kv GROUP BY id, key""",
)
def settings_lines(found: DataFrame) -> DataFrame:
    """S17."""
    return found.select("id", F.explode(readers.settings(F.col("text"))).alias("key", "value"))


XHTML = Rows(
    "doc_id bigint, page int, xhtml string",
    (
        (1, 1, '<page width="595"><word xMin="10.5" yMin="20" xMax="30" yMax="32.25">x&lt;y</word>\n<word xMin="35" yMin="20" xMax="50" yMax="32">&amp;amp;</word></page>'),
        (1, 2, '<page/>'),
        (2, 1, '<word yMin="-4.5" xMax="bad" yMax="3">solo</word><word xMin="1" yMin="2" xMax="3" yMax="4"></word>'),
    ),
)


@sample(
    "word_boxes",
    {"p": XHTML},
    r"""AND w AS (SELECT doc_id, page, unnest(regexp_extract_all(xhtml, '<word ([^>]+)>([^<]*)</word>', 1)) AS a, unnest(regexp_extract_all(xhtml, '<word ([^>]+)>([^<]*)</word>', 2)) AS t FROM p)
    SELECT doc_id, page, """
    + ", ".join(rf"""coalesce(try_cast(nullif(regexp_extract(a, '{n}="([\d.\-]+)"', 1), '') AS DOUBLE), 0.0::DOUBLE) AS {c}""" for n, c in (("xMin", "x0"), ("yMin", "y0"), ("xMax", "x1"), ("yMax", "y1")))
    + ", replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS txt FROM w",
)
def word_boxes(pages: DataFrame) -> DataFrame:
    """S4. A side that is missing or no number is 0."""
    return readers.page_words(pages)


OUTLINE = Rows("doc_id bigint, seq int, title string, level int, page0 int", ((1, 0, " Capitolo   1 ", 1, 0), (1, 1, "  ", 2, 3), (1, 2, "Parte\tA", 2, 4), (1, 3, "senza pagina", 1, None), (1, 4, "Fine", 1, 9), (2, 0, "Unico", 1, 2)))
BY_SIZE = Rows("doc_id bigint, seq int, page int, title string, level int", ((1, 0, 1, "per dimensione", 1), (2, 0, 1, "primo", 1), (2, 5, 2, "secondo", 2), (3, 0, 7, "altro", 1)))
_OUTLINE = r"o AS (SELECT doc_id, seq, trim(regexp_replace(title, '\s+', ' ', 'g')) AS title, level, page0 + 1 AS page FROM raw WHERE trim(regexp_replace(title, '\s+', ' ', 'g')) <> '' AND page0 IS NOT NULL)"


@sample("outline_entries", {"raw": OUTLINE}, f"AND {_OUTLINE} SELECT doc_id, seq, title, level, page FROM o")
def outline_entries(outline: DataFrame) -> DataFrame:
    """S6."""
    return readers.outline_rows(outline)


@sample(
    "document_structure",
    {"raw": OUTLINE, "s": BY_SIZE},
    f"AND {_OUTLINE}, enough AS (SELECT doc_id FROM o GROUP BY doc_id HAVING count(*) >= 3) SELECT doc_id, seq, page, title, level FROM o WHERE doc_id IN (FROM enough) UNION ALL SELECT doc_id, seq, page, title, level FROM s WHERE doc_id NOT IN (FROM enough)",
)
def document_structure(outline: DataFrame, by_size: DataFrame) -> DataFrame:
    """C1."""
    return structure.outline_or_sizes(readers.outline_rows(outline), by_size)


INFO = Rows("doc_id bigint, info string", ((1, "Title:          Analisi 1\nAuthor: \nCreationDate:   Mon Jan  1\nPages: 20"), (2, "Author: Rossi\nTitle:\n"), (3, "")))


@sample(
    "document_metadata",
    {"i": INFO},
    " UNION ALL ".join(rf"SELECT doc_id, '{k}' AS key, trim(regexp_extract(info, '(?m)^{k}:[ \t]*(.*)$', 1)) AS value FROM i WHERE trim(regexp_extract(info, '(?m)^{k}:[ \t]*(.*)$', 1)) <> ''" for k in ("Title", "Author", "CreationDate")),
)
def document_metadata(found: DataFrame) -> DataFrame:
    """S7."""
    return found.select("doc_id", F.explode(readers.metadata(F.col("info"))).alias("key", "value"))


LISTING = Rows("line string", (("page   num  type   width height color",), ("--------------------",), ("   1     0 image     640   480  rgb",), ("   2     1 smask     640   480  gray",), ("  12     3 image      32    x",), ("   3     2 image     900    50  rgb  8",)))


@sample(
    "image_listing",
    {"l": LISTING},
    r"""AND c AS (SELECT regexp_split_to_array(trim(line), '\s+') AS c FROM l)
    SELECT try_cast(c[1] AS INTEGER) AS page, try_cast(c[2] AS INTEGER) AS num, try_cast(c[4] AS INTEGER) AS width, try_cast(c[5] AS INTEGER) AS height FROM c WHERE c[3] = 'image' AND try_cast(c[5] AS INTEGER) IS NOT NULL""",
)
def image_listing(listing: DataFrame) -> DataFrame:
    """S8."""
    return readers.image_list(listing)


STREAM = Rows(
    "id bigint, line string",
    (
        (1, 'data: {"type":"a","properties":{"sessionID":"s1"}}'),
        (2, ": commento"),
        (3, 'data:{"type":"b","properties":{"sessionID":"s2"}}'),
        (4, 'data: {"type":"server.connected"}'),
        (5, ""),
        (6, "event: x"),
    ),
)


@sample("session_events", {"s": STREAM}, "AND d AS (SELECT id, trim(line[6:]) AS data FROM s WHERE starts_with(line, 'data:')) SELECT id, data FROM d WHERE coalesce(json_extract_string(data, '$.properties.sessionID'), 's1') = 's1'")
def session_events(stream: DataFrame) -> DataFrame:
    """S14."""
    data = stream.select("id", readers.sse_data(F.col("line")).alias("data")).where("data is not null")
    return readers.of_session(data, "s1")


LINES = Rows("run_id bigint, event_id bigint, line string", ((1, 1, ""), (1, 2, "non json"), (1, 3, '{"event":"step_update","step_update":{"step_type":"tool"}}'), (1, 4, '{"event":"result","result":{"status":"ok"}}'), (1, 5, '{"event":"result","result":{"status":"no"}}'), (1, 6, '{"event":"closed"}'), (1, 7, '{"altro":1}'), (1, 8, "   ")))


@sample(
    "raw_event_lines",
    {"l": LINES},
    """AND j AS (SELECT *, CASE WHEN json_valid(line) THEN line END AS d FROM l),
    k AS (SELECT *, json_extract_string(d, '$.event') AS kind, json_extract_string(d, '$.result.status') AS status FROM j)
    SELECT event_id, CASE WHEN kind = 'result' THEN CASE WHEN status = 'ok' THEN 'finito' ELSE 'fallito' END WHEN kind = 'closed' THEN 'chiuso' ELSE 'vivo' END AS fact,
      CASE WHEN trim(line) = '' THEN 'riga_vuota' WHEN d IS NULL THEN 'riga_non_json' ELSE coalesce(json_extract_string(d, '$.step_update.step_type'), kind, 'sconosciuto') END AS type, d AS detail FROM k""",
)
def raw_event_lines(lines: DataFrame) -> DataFrame:
    """Also lines that are blank or no JSON."""
    return lines.select("event_id", supervision.normalized(F.col("line")).alias("e")).select("event_id", "e.fact", "e.type", "e.detail")


IDLE = Rows("run_id bigint, ts int", ((1, 10), (1, 30), (1, 40), (2, 5), (3, 50)))
ANSWERS = Rows("run_id bigint, ts int, role string, completed boolean, text string", ((1, 20, "assistant", True, "ecco"), (1, 5, "user", True, "domanda"), (2, 3, "assistant", False, "a metà"), (2, 4, "assistant", True, "  "), (3, 50, "assistant", True, "ok")))


@sample("confirmed_finish", {"i": IDLE, "m": ANSWERS}, "SELECT i.run_id, min(i.ts) AS finished FROM i JOIN m ON m.run_id = i.run_id AND i.ts >= m.ts WHERE role = 'assistant' AND completed AND trim(coalesce(text, '')) <> '' GROUP BY i.run_id")
def confirmed_finish(idle: DataFrame, answers: DataFrame) -> DataFrame:
    """X6."""
    return supervision.confirmed(idle, answers)


OUTCOMES = Rows("run_id bigint, outcome string", ((1, "finito_bene"), (2, "finito_bene"), (3, "fallito"), (4, "finito_bene"), (5, "finito_bene")))
OUTPUTS = Rows("run_id bigint, output string", ((1, "testo"), (2, "  "), (3, "x"), (4, "y")))
EXPECTED = Rows("run_id bigint, path string", ((1, "a"), (1, "b"), (4, "a"), (4, "c"), (3, "a")))
PRESENT = Rows("run_id bigint, path string", ((1, "b"), (1, "a"), (4, "a"), (1, "a")))


@sample(
    "run_health",
    {"o": OUTCOMES, "t": OUTPUTS, "e": EXPECTED, "p": PRESENT},
    """AND m AS (SELECT run_id, string_agg(DISTINCT path, ',' ORDER BY path) AS missing FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.run_id = e.run_id AND p.path = e.path) GROUP BY run_id)
    SELECT run_id, coalesce(missing, '') AS missing, outcome = 'finito_bene' AND trim(coalesce(output, '')) <> '' AND missing IS NULL AS healthy FROM o LEFT JOIN t USING (run_id) LEFT JOIN m USING (run_id)""",
)
def run_health(outcome: DataFrame, outputs: DataFrame, expected: DataFrame, present: DataFrame) -> DataFrame:
    """X7."""
    return supervision.healthy(outcome, outputs, expected, present).select("run_id", F.array_join("missing", ",").alias("missing"), "healthy")


ASKED = Rows("id bigint, kind string, own string, any_kind string", ((1, "bash", "allow", "reject"), (2, "edit", None, "once"), (3, "web", None, None)))


@sample("permission_answers", {"a": ASKED}, "SELECT id, coalesce(own, any_kind, 'reject') AS answer FROM a")
def permission_answers(asked: DataFrame) -> DataFrame:
    """X10. own and any_kind: the policy's entries for the kind and for ``*``."""
    entries = F.filter(F.array(F.struct(F.col("kind").alias("key"), F.col("own").alias("value")), F.struct(F.lit("*").alias("key"), F.col("any_kind").alias("value"))), lambda e: e["value"].isNotNull())
    return asked.select("id", supervision.answer(F.map_from_entries(entries), F.col("kind")).alias("answer"))


CHECKS = Rows("host string, ts int, slept_s double", (("a", 1, 0.0), ("a", 2, 10.0), ("a", 3, 200.0), ("a", 4, 260.0), ("b", 1, 500.0), ("b", 2, 561.0)))


@sample("host_wakes", {"c": CHECKS}, "SELECT host, ts, coalesce(slept_s - lag(slept_s) OVER (PARTITION BY host ORDER BY ts) > 60, false) AS woke FROM c")
def host_wakes(checks: DataFrame) -> DataFrame:
    """W12."""
    return supervision.wakes(checks).select("host", "ts", "woke")


FLAGS = Rows("host string, busy boolean, music boolean, upload boolean", (("a", True, False, True), ("b", False, False, False), ("c", None, True, False)))


@sample("reasons_awake", {"f": FLAGS}, "SELECT host, concat_ws(',', CASE WHEN busy THEN 'busy' END, CASE WHEN music THEN 'music' END, CASE WHEN upload THEN 'upload' END) AS reasons FROM f")
def reasons_awake(flags: DataFrame) -> DataFrame:
    """X12."""
    return flags.select("host", F.array_join(supervision.reasons_to_stay({c: F.col(c) for c in ("busy", "music", "upload")}), ",").alias("reasons"))


REQUESTS = Rows("request_id bigint, chat_id bigint, ts int", ((1, 7, 20), (2, 9, 10), (3, 7, 5), (4, 9, 5), (5, 7, 30)))


@sample("owner_requests", {"r": REQUESTS}, "SELECT * FROM r WHERE chat_id = (SELECT chat_id FROM r ORDER BY ts, request_id LIMIT 1)")
def owner_requests(requests: DataFrame) -> DataFrame:
    """P19."""
    return readers.owned(requests).select("request_id", "chat_id", "ts")


@sample("failed_documents", {"t": TEXTS}, "SELECT id, CASE WHEN text = '' THEN 'vuoto' WHEN length(text) > 2000 THEN 'lungo' END AS reason FROM t")
def failed_documents(texts: DataFrame) -> DataFrame:
    """K6: those that pass have no reason."""
    good, bad = readers.quarantined(texts, F.when(F.col("text") == "", "vuoto").when(F.length("text") > 2000, "lungo"))
    return good.select("id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("id", "reason"))


PAIRS = Rows("key string, value string, ts int", (("a", "1", 1), ("a", "2", 3), ("a", "3", 2), ("b", None, 5), ("b", "x", 4)))


@sample("latest_values", {"p": PAIRS}, "SELECT key, value FROM p QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC) = 1")
def latest_values(pairs: DataFrame) -> DataFrame:
    """D3, the upsert: the last value counts, also a null one."""
    return readers.latest(pairs)


CACHED = Rows("url string, inserted int", tuple((f"u{i}", i * 8 % 301) for i in range(301)))


@sample("page_cache", {"c": CACHED}, "SELECT url FROM c QUALIFY row_number() OVER (ORDER BY inserted DESC) <= 200")
def page_cache(cached: DataFrame) -> DataFrame:
    """What a cache of 200 holds that evicts the oldest."""
    return readers.newest(cached).select("url")


LANES = Rows("url string, fast string, slow string", (("a", "x", "y"), ("b", None, "z"), ("c", None, None)))


@sample("fetch_lanes", {"l": LANES}, "SELECT url, coalesce(fast, slow) AS body FROM l")
def fetch_lanes(lanes: DataFrame) -> DataFrame:
    """S10."""
    return lanes.select("url", readers.first_lane(F.col("fast"), F.col("slow")).alias("body"))


PAGES = Rows(
    "doc_id bigint, page int, svg string, text string",
    (
        (1, 1, "<path d=''/>" * 400 + "<rect/>" * 101, "prosa\nFigura 3: Il motore\naltro"),
        (1, 2, "<line/>" * 500, "TABELLA 12. Valori \nFig. 2 dopo"),
        (1, 3, "<paths/>" * 900, "nella figura 3 si vede"),
        (2, 1, "<circle r='1'/>" * 600, "Fig. senza numero"),
    ),
)


@sample("vector_figures", {"p": PAGES}, r"AND c AS (SELECT doc_id, page, len(regexp_extract_all(svg, '<(path|line|rect|circle|ellipse|polygon|polyline)\b'))::INTEGER AS n_elements FROM p) SELECT * FROM c WHERE n_elements > 500")
def vector_figures(pages: DataFrame) -> DataFrame:
    """P16."""
    return media.vector_pages(pages).select("doc_id", "page", "n_elements")


@sample("page_captions", {"p": PAGES}, r"SELECT doc_id, page, nullif(trim(regexp_extract(text, '(?im)^(Figure|Fig\.|Figura|Tabella|Table)\s*\d+[.:\-]?\s*(.*)$')), '') AS caption FROM p")
def page_captions(pages: DataFrame) -> DataFrame:
    """P17."""
    return pages.select("doc_id", "page", media.caption(F.col("text")).alias("caption"))


RASTER = Rows("doc_id bigint, page int, w int, h int", ((1, 1, 640, 480), (2, 3, 100, 90)))


@sample("all_figures", {"r": RASTER, "p": PAGES}, r"SELECT doc_id, page, 'raster' AS kind, w, NULL::INTEGER AS n_elements FROM r UNION ALL SELECT doc_id, page, 'vector', NULL, n FROM (SELECT doc_id, page, len(regexp_extract_all(svg, '<(path|line|rect|circle|ellipse|polygon|polyline)\b'))::INTEGER AS n FROM p) WHERE n > 500")
def all_figures(raster: DataFrame, pages: DataFrame) -> DataFrame:
    """D10."""
    return media.all_figures(raster, media.vector_pages(pages).select("doc_id", "page", "n_elements")).select("doc_id", "page", "kind", "w", "n_elements")


BLOCKED = Rows(
    "id bigint, text string",
    (
        (1, "Prosa.\n\n<!-- tabella pag 1 blocco 1 -->\n\n```\n\n1 2\n3 4\n\n```\n\n<!-- formula pag 1 blocco 1 -->\n```\nx^2_i + y^2\n```\nfine"),
        (2, "solo prosa ^ _"),
        (3, ""),
        (4, "<!-- formula pag 9 blocco 2 -->```a_1```"),
        (5, "<!-- tabella pag 1 blocco 1 --> senza recinto"),
    ),
)
_BLOCK = lexicons.BLOCK.replace("'", "''")


@sample(
    "block_counts",
    {"b": BLOCKED},
    r"""AND f AS (SELECT id, text, array_to_string(regexp_extract_all(text, '(?s)<!-- formula pag [^>]* -->\s*```\s*(.*?)```', 1), '') AS fs FROM b)
    SELECT id, len(string_split(text, '<!-- tabella pag')) - 1 AS n_tables, len(string_split(text, '<!-- formula pag')) - 1 AS n_formulas, length(fs) - length(replace(fs, '^', '')) AS n_raised, length(fs) - length(replace(fs, '_', '')) AS n_lowered FROM f""",
)
def block_counts(blocked: DataFrame) -> DataFrame:
    """A11."""
    return blocked.select("id", *[c.cast("long").alias(n) for n, c in chunking.block_counts(F.col("text")).items()])


@sample("placeholder_shares", {"b": BLOCKED}, rf"AND s AS (SELECT id, length(array_to_string(regexp_extract_all(text, '{_BLOCK}'), '')) AS held, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n FROM b) SELECT id, round(CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE held::DOUBLE / n END, 9) AS share FROM s")
def placeholder_shares(blocked: DataFrame) -> DataFrame:
    """A17."""
    return blocked.select("id", F.round(chunking.placeholder_share(F.col("text")), 9).alias("share"))


@sample(
    "block_split",
    {"b": BLOCKED},
    "SELECT id, "
    + "regexp_replace(regexp_replace(text, '{t}', '{pt}', 'g'), '{f}', '{pf}', 'g') AS for_model, ".format(
        t=_BLOCK.replace("(tabella|formula)", "tabella"), f=_BLOCK.replace("(tabella|formula)", "formula"), pt=lexicons.PLACEHOLDERS["tabella"].replace("'", "''"), pf=lexicons.PLACEHOLDERS["formula"].replace("'", "''")
    )
    + f"array_to_string(list_transform(regexp_extract_all(text, '{_BLOCK}'), lambda x: CASE WHEN starts_with(x, '<!-- tabella') THEN '**Tabella**' ELSE '**Formula**' END || chr(10) || chr(10) || x), chr(10) || chr(10)) AS material FROM b",
)
def block_split(blocked: DataFrame) -> DataFrame:
    """what the model gets, and what stays as it is."""
    return blocked.select("id", chunking.for_model(F.col("text")).alias("for_model"), chunking.material(F.col("text")).alias("material"))


BULLETS = Rows("id bigint, bullets array<string>", ((1, ["A", "b", "a", "c", "D", "e"]), (2, []), (3, ["x", "X", "x"])))


@sample("merged_bullets", {"b": BULLETS}, "SELECT id, array_to_string(list_filter(bullets, lambda x, i: list_position(list_transform(bullets, lambda y: lower(y)), lower(x)) = i)[1:4], '|') AS merged FROM b")
def merged_bullets(found: DataFrame) -> DataFrame:
    """A20."""
    return found.select("id", F.array_join(chunking.merged_bullets(F.col("bullets")), "|").alias("merged"))


MEDIA = Rows("id bigint, photos array<string>, kind string, document string", ((1, ["small", "large"], None, None), (2, [], "image/png", "doc1"), (3, None, "application/pdf", "doc2"), (4, ["p"], "image/jpeg", "doc3"), (5, None, None, None)))


@sample("message_images", {"m": MEDIA}, "SELECT id, coalesce(photos[-1], CASE WHEN starts_with(kind, 'image/') THEN document END) AS image FROM m")
def message_images(found: DataFrame) -> DataFrame:
    """F29."""
    return found.select("id", notes.image_of(F.col("photos"), F.col("kind"), F.col("document")).alias("image"))


PARAGRAPHS = Rows(
    "id bigint, pos int, n int, text string",
    (
        (1, 0, 4, "La pressione dell'acqua nella centrale termica sale quando la temperatura aumenta oltre i limiti."),
        (2, 1, 4, "Iscriviti alla newsletter per ricevere notizie sulla pressione dell'acqua."),
        (3, 2, 4, "Tutti i diritti riservati. Acqua e pressione."),
        (4, 3, 4, "Nessuna parola in comune con la domanda posta."),
        (5, 0, 0, "acqua"),
        (6, 1, 2, "Questo testo non sostituisce il parere; consultare un medico per la pressione."),
    ),
)
_ASKED = ["pressione", "acqua", "centrale"]


@sample(
    "paragraph_rules",
    {"p": PARAGRAPHS},
    rf"""SELECT id, round(CASE WHEN regexp_matches(text, '(?i){lexicons.BOILERPLATE}') THEN 0.0::DOUBLE ELSE len(list_intersect({_ASKED}, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))) / (1.0::DOUBLE + length(text) / 800.0::DOUBLE) + 0.35::DOUBLE * (1.0::DOUBLE - pos / greatest(n, 1)::DOUBLE) END, 9) AS score FROM p""",
)
def paragraph_rules(found: DataFrame) -> DataFrame:
    """Boilerplate scores nothing."""
    keys = F.array(*[F.lit(k) for k in _ASKED])
    return found.select("id", F.round(retrieval.paragraph_score(F.col("text"), keys, F.col("pos"), F.col("n")), 9).alias("score"))


RESULTS = Rows(
    "query_id bigint, pos int, url string",
    (
        (1, 0, "https://www.negozio.it/"),
        (1, 1, "https://negozio.it/prodotto"),
        (1, 2, "https://a.it"),
        (1, 3, "http://b.it:8080/x?y=1"),
        (1, 4, "non un url"),
        (1, 5, "https://c.it/?q=/"),
        (1, 6, "https://d.it/p"),
        (2, 0, "https://solo.it"),
        (2, 1, None),
    ),
)


@sample(
    "shortlist_rules",
    {"r": RESULTS},
    r"""AND s AS (SELECT *, regexp_replace(regexp_extract(coalesce(url, ''), '^[^:/?#]+://([^/?#]*)', 1), '^www\.', '') AS site, trim(regexp_extract(coalesce(url, ''), '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/') = '' AS storefront FROM r),
    u AS (SELECT * FROM s WHERE site <> '' QUALIFY row_number() OVER (PARTITION BY query_id, site ORDER BY storefront, pos) = 1)
    SELECT query_id, pos, site, storefront, row_number() OVER (PARTITION BY query_id ORDER BY storefront, pos) AS place FROM u QUALIFY place <= 3""",
)
def shortlist_rules(results: DataFrame) -> DataFrame:
    """Storefronts come last."""
    return retrieval.shortlist(results, by="query_id").select("query_id", "pos", "site", "storefront", "place")


WORK = Rows("source string, piece int", (("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 4)))
DONE = Rows("source string, piece int", (("a", 1), ("b", 1), ("a", 9)))


@sample("first_pending", {"w": WORK, "d": DONE}, "SELECT source, min(piece) AS piece FROM w WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.source = w.source AND d.piece = w.piece) GROUP BY source")
def first_pending(work: DataFrame, done: DataFrame) -> DataFrame:
    """J4."""
    return structure.next_pending(work, done, keys=["source", "piece"], by="source", order="piece").select("source", "piece")


@sample("pages_to_write", {"p": XHTML, "d": Rows("doc_id bigint, page int", ((1, 1), (1, 1), (2, 7)))}, "SELECT doc_id, page FROM p WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = p.doc_id AND d.page = p.page)")
def pages_to_write(pages: DataFrame, written: DataFrame) -> DataFrame:
    """K1."""
    return notes.missing_pages(pages, written).select("doc_id", "page")


BODIES = Rows("page int, prose string, tables array<string>, formulas array<string>", ((1, "prosa", ["1 2", ""], ["x^2"]), (2, "", [], []), (3, "", ["a"], []), (4, "solo", [], [])))


@sample(
    "page_bodies",
    {"p": BODIES},
    "AND f AS (SELECT page, list_filter([prose], lambda x: x <> '') AS a, "
    + ", ".join(f"list_transform(list_filter({c}, lambda x: x <> ''), lambda x, i: '<!-- {k} pag ' || page || ' blocco ' || i || ' -->' || chr(10) || chr(10) || '```' || chr(10) || chr(10) || x || chr(10) || chr(10) || '```') AS {n}" for c, k, n in (("tables", "tabella", "b"), ("formulas", "formula", "c")))
    + " FROM p) SELECT page, array_to_string(a || b || c, chr(10) || chr(10)) AS body FROM f",
)
def page_bodies(found: DataFrame) -> DataFrame:
    """F28."""
    return found.select("page", notes.page_body(F.col("prose"), F.col("tables"), F.col("formulas"), F.col("page")).alias("body"))


NAMED = Rows("doc_id bigint, seq int, number string, title string", ((1, 0, None, "A"), (1, 1, None, "A (2)"), (1, 2, None, "A"), (1, 3, None, "A"), (1, 4, "1.2", "B|x"), (2, 0, None, "A"), (2, 1, None, "A (2)")))


@sample("unused_names", {"n": NAMED}, "SELECT * FROM (VALUES (1::BIGINT, 0, 'Doc A'), (1, 1, 'Doc A (2)'), (1, 2, 'Doc A (3)'), (1, 3, 'Doc A (4)'), (1, 4, 'Doc 1.2 B x'), (2, 0, 'Doc A'), (2, 1, 'Doc A (2)')) AS t(doc_id, seq, name)")
def unused_names(found: DataFrame) -> DataFrame:
    """A suffix that a title has already is passed over. The SQL states the names."""
    return structure.named(found, F.lit("Doc")).select("doc_id", "seq", "name")


LOOKED_UP = Rows(
    "conv_id bigint, quote_id int, turn int, quote string",
    (
        (1, 1, 1, "Ho deciso di partire"),
        (1, 2, 2, "Programma!"),
        (1, 3, 3, "dimmi la ora e scrivi tutto subito"),
        (1, 4, 3, "nulla che ci sia davvero"),
        (1, 5, 9, "Ho deciso"),
        (2, 6, 2, "abita"),
        (2, 7, 2, "abit roma"),
        (3, 8, 1, "noi"),
        (3, 9, 3, ""),
    ),
)


@sample(
    "fact_lookup",
    {"m": SAID, "q": LOOKED_UP},
    rf"""AND f AS (SELECT q.conv_id, quote_id, role, {_QUOTE_FORM.replace('@', "coalesce(m.text, '')")} AS t, {_QUOTE_FORM.replace('@', "coalesce(quote, '')")} AS q FROM q LEFT JOIN m ON m.conv_id = q.conv_id AND m.turn = q.turn),
    w AS (SELECT *, regexp_extract_all(q, '[\p{{L}}\p{{N}}_]+') AS qs, regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+') AS ts FROM f),
    r AS (SELECT *, CASE WHEN role IS NULL OR q = '' THEN 0 WHEN contains(t, q) THEN length(q) WHEN len(qs) = 1 THEN CASE WHEN list_contains(ts, qs[1]) THEN length(qs[1]) ELSE 0 END
      ELSE coalesce(length(list_filter(flatten(list_transform(range(least(15, len(qs)), 1, -1), lambda k: list_transform(range(1, len(qs) - k + 2), lambda i: array_to_string(qs[i:i + k - 1], ' ')))), lambda x: contains(array_to_string(ts, ' '), x))[1]), 0) END::BIGINT AS match_len FROM w)
    SELECT conv_id, quote_id, CASE WHEN match_len > 0 THEN role END AS quoted_role, match_len FROM r""",
)
def fact_lookup(said: DataFrame, looked_up: DataFrame) -> DataFrame:
    """J8 with its fallbacks."""
    return facts.attributed_by_id(looked_up, said)


ANCHORED = Rows(
    "id bigint, page int, md string",
    (
        (1, 2, "<!-- pag 1 -->\nuno\n<!-- pag 2 -->\n\ndue <!-- x --> tre\n```\n1 2\n```\nquattro"),
        (2, 3, "<!-- pag 1 -->\nuno"),
        (3, 1, "<!-- pag 1 --> in linea\n<!-- pag 1 -->\n" + "parola, " * 200),
        (4, 1, "<!-- pag 1 -->\n" + "x" * 700),
    ),
)


@sample(
    "page_excerpts",
    {"a": ANCHORED},
    r"""AND s AS (SELECT *, '<!-- pag ' || page || ' -->' || chr(10) AS mark FROM a),
    p AS (SELECT id, CASE WHEN contains(md, mark) THEN trim(regexp_replace(regexp_replace(regexp_replace(md[strpos(md, mark) + length(mark):], '(?s)```.*?```', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '\s+', ' ', 'g')) ELSE '' END AS t FROM s),
    h AS (SELECT *, t[1:600] AS head FROM p)
    SELECT id, CASE WHEN length(t) <= 600 THEN t ELSE regexp_replace(CASE WHEN contains(head, ' ') THEN regexp_extract(head, '(?s)^(.*) ', 1) ELSE head END, '[ ,;:\-]+$', '') || '…' END AS excerpt FROM h""",
)
def page_excerpts(anchored: DataFrame) -> DataFrame:
    """From the page's anchor on."""
    return anchored.select("id", tx.page_excerpt(F.col("md"), F.col("page")).alias("excerpt"))


@sample(
    "second_engine_events",
    {"s": Rows("id bigint, data string", (
        (1, '{"type":"server.connected"}'),
        (2, '{"type":"session.status","properties":{"sessionID":"s1","status":{"type":"retry","attempt":2}}}'),
        (3, '{"type":"session.status","properties":{"sessionID":"s1","status":{"type":"idle"}}}'),
        (4, '{"type":"session.idle","properties":{"sessionID":"s1"}}'),
        (5, '{"type":"session.error","properties":{"sessionID":"s1","error":{"name":"x"}}}'),
        (6, '{"type":"message.part.updated","properties":{"part":{"type":"tool","tool":"bash"}}}'),
        (7, '{"type":"session.idle","properties":{"sessionID":"s2"}}'),
        (8, "non json"),
        (9, '{"type":"session.status","properties":{"sessionID":"","status":{"type":"busy"}}}'),
        (10, '{"altro":1}'),
    ))},
    """AND j AS (SELECT *, CASE WHEN json_valid(data) THEN data END AS d FROM s),
    k AS (SELECT *, json_extract_string(d, '$.type') AS kind, CASE json_extract_string(d, '$.type') WHEN 'session.status' THEN json_extract_string(d, '$.properties.status.type') WHEN 'message.part.updated' THEN json_extract_string(d, '$.properties.part.type') END AS state FROM j WHERE coalesce(json_extract_string(d, '$.properties.sessionID'), '') IN ('', 's1'))
    SELECT id, CASE WHEN kind = 'session.error' THEN 'fallito' WHEN kind = 'session.idle' OR (kind = 'session.status' AND state = 'idle') THEN 'idle' ELSE 'vivo' END AS fact, CASE WHEN d IS NULL THEN 'sse_non_json' ELSE coalesce(kind, 'None') END AS type, state FROM k""",
)
def second_engine_events(stream: DataFrame) -> DataFrame:
    """X1 for event streams."""
    read = stream.select("id", supervision.normalized_session(F.col("data"), "s1").alias("e")).where("e is not null")
    return read.select("id", "e.fact", "e.type", "e.state")


@sample(
    "closed_streams",
    {"e": Rows("run_id bigint, event_id bigint, ts int, fact string, alive boolean", ((1, 1, 5, "vivo", True), (1, 2, 6, "finito", True), (2, 1, 7, "vivo", True))), "d": Rows("run_id bigint, event_id bigint, ts int", ((1, 9, 20), (2, 9, 21), (3, 9, 22)))},
    "SELECT run_id, event_id, ts, fact FROM e UNION ALL SELECT run_id, event_id, ts, 'chiuso' FROM d WHERE run_id NOT IN (SELECT run_id FROM e WHERE fact IN ('finito', 'fallito', 'chiuso'))",
)
def closed_streams(events: DataFrame, ended: DataFrame) -> DataFrame:
    """The end of a stream."""
    return supervision.closed(events, ended).select("run_id", "event_id", "ts", "fact")


@sample("idle_models", {"m": Rows("name string, loaded boolean, idle_s double, idle_locked_s double", (("a", True, 600.0, 600.0), ("b", True, 900.0, 2.0), ("c", False, 900.0, 900.0), ("d", True, 599.9, 700.0), ("e", True, None, None)))}, "SELECT name FROM m WHERE loaded AND idle_s >= 600 AND idle_locked_s >= 600")
def idle_models(models: DataFrame) -> DataFrame:
    """X13."""
    return supervision.evicted(models).select("name")


@sample("text_pages", {"t": Rows("doc_id bigint, text string", ((1, "uno\fdue\f"), (2, "solo"), (3, "a\f\fc\f"), (4, "")))}, "AND c AS (SELECT doc_id, string_split(regexp_replace(text, chr(12) || '$', ''), chr(12)) AS ps FROM t) SELECT doc_id, generate_subscripts(ps, 1)::INTEGER AS page, unnest(ps) AS text FROM c")
def text_pages(texts: DataFrame) -> DataFrame:
    """S3."""
    return readers.pages_of_text(texts)


@sample(
    "metasearch_results",
    {"a": Rows("query_id bigint, body string", ((1, '{"results":[{"url":"https://a.it","title":"A","content":"x"},{"url":"https://b.it","title":null,"extra":1}]}'), (2, '{"results":[]}'), (3, "errore"), (4, '{"altro":2}')))},
    """AND j AS (SELECT query_id, json_extract(body, '$.results[*]') AS rs FROM a WHERE json_valid(body)), e AS (SELECT query_id, generate_subscripts(rs, 1)::INTEGER - 1 AS pos, unnest(rs) AS r FROM j)
    SELECT query_id, pos, json_extract_string(r, '$.url') AS url, json_extract_string(r, '$.title') AS title, json_extract_string(r, '$.content') AS content FROM e""",
)
def metasearch_results(answers: DataFrame) -> DataFrame:
    """S9."""
    return readers.metasearch(answers)


@sample("polled_updates", {"u": Rows("update_id bigint, text string", ((4, "vecchio"), (7, "b"), (5, "a")))}, "SELECT update_id, text, update_id + 1 AS next_offset FROM u WHERE update_id >= 5")
def polled_updates(updates: DataFrame) -> DataFrame:
    """S15."""
    return readers.updates_since(updates, 5)


@sample(
    "tool_history",
    {"m": Rows("id bigint, role string, text string, tool_calls string, call_id string", ((1, "user", "ciao", None, None), (2, "assistant", "vedo", '[{"id":"c1","name":"cerca"},{"id":"c2","name":"leggi"}]', None), (3, "tool", "esito", None, "c1"), (4, "tool", None, "[]", "c2"), (5, "assistant", None, "", None)))},
    """AND h AS (SELECT *, role <> 'tool' AND coalesce(tool_calls, '') <> '' AS has FROM m)
    SELECT id, CASE WHEN role = 'tool' THEN 'tool' WHEN has THEN 'assistant' ELSE role END AS role, CASE WHEN NOT has THEN coalesce(text, '') END AS content, CASE WHEN has THEN array_to_string(json_extract_string(tool_calls, '$[*].name'), ',') END AS names, CASE WHEN role = 'tool' THEN call_id END AS call_id FROM h""",
)
def tool_history(messages: DataFrame) -> DataFrame:
    """History shaping with tools' messages."""
    return readers.history(messages).select("id", "role", "content", F.array_join(F.transform("calls", lambda c: c["name"]), ",").alias("names"), "call_id")


@sample("live_locks", {"l": Rows("path string, pid bigint", (("a", 10), ("b", 11), ("c", 12))), "p": Rows("pid bigint", ((10,), (12,), (12,)))}, "SELECT path, pid, pid IN (SELECT pid FROM p) AS held FROM l")
def live_locks(locks: DataFrame, processes: DataFrame) -> DataFrame:
    """J13."""
    return readers.live(locks, processes)


@sample(
    "page_differences",
    {"x": Rows("doc_id bigint, page int", ((1, 1), (1, 2), (1, 3), (2, 1))), "p": Rows("doc_id bigint, page int", ((1, 1), (1, 1), (1, 3), (2, 1), (2, 2)))},
    "SELECT doc_id, page, 'missing' AS side FROM (SELECT * FROM x EXCEPT ALL SELECT * FROM p) UNION ALL SELECT doc_id, page, 'unexpected' FROM (SELECT * FROM p EXCEPT ALL SELECT * FROM x)",
)
def page_differences(expected: DataFrame, present: DataFrame) -> DataFrame:
    """2.7: the pages that are expected are those that are there."""
    return readers.page_differences(expected, present)


SOURCES = Rows("id bigint, source string", ((1, "breve"), (2, "parola   " * 60), (3, "Prosa lunga. " * 20 + "<!-- tabella pag 1 blocco 1 -->\n```\n1 2\n```\nfine"), (4, "x " * 9000)))


@sample(
    "section_path",
    {"b": SOURCES},
    rf"""AND n AS (SELECT *, length(trim(regexp_replace(source, '\s+', ' ', 'g'))) AS n_chars, length(array_to_string(regexp_extract_all(source, '{_BLOCK}'), '')) AS held FROM b)
    SELECT id, n_chars, round(CASE WHEN n_chars = 0 THEN 0.0::DOUBLE ELSE held::DOUBLE / n_chars END, 9) AS share, CASE WHEN n_chars < 200 THEN 'fonte troppo corta: ' || n_chars || ' caratteri' END AS reason, n_chars >= 200 AND n_chars > 15417 AS divided,
      CASE WHEN n_chars >= 200 THEN regexp_replace(source, '{_BLOCK.replace("(tabella|formula)", "tabella")}', '{lexicons.PLACEHOLDERS["tabella"].replace("'", "''")}', 'g') END AS for_model,
      CASE WHEN n_chars >= 200 THEN array_to_string(list_transform(regexp_extract_all(source, '{_BLOCK}'), lambda x: '**Tabella**' || chr(10) || chr(10) || x), chr(10) || chr(10)) END AS material FROM n""",
)
def section_path(sources: DataFrame) -> DataFrame:
    """C7 up to the model, with P18's reasons."""
    return chunking.sections_for_model(sources).select("id", "n_chars", F.round("placeholder_share", 9).alias("share"), "reason", "divided", "for_model", "material")


@sample(
    "model_throughput",
    {"r": Rows("id bigint, tokens bigint, model_ns bigint, wall_s double, parts int", ((1, 100, 2000000000, 9.0, 1), (2, 100, 2000000000, 9.0, 3), (3, 5, 0, 1.0, 1), (4, 5, 10, 0.0, 2)))},
    "SELECT id, coalesce(round(CASE WHEN parts > 1 THEN tokens / nullif(wall_s, 0) ELSE tokens * 1e9::DOUBLE / nullif(model_ns, 0) END, 1), 0.0::DOUBLE) AS tokens_s FROM r",
)
def model_throughput(runs: DataFrame) -> DataFrame:
    """A18, both definitions."""
    return runs.select("id", chunking.throughput(F.col("tokens"), F.col("model_ns"), F.col("wall_s"), F.col("parts")).alias("tokens_s"))


@sample(
    "changed_work",
    {"w": Rows("note string, text string", (("a", "uno"), ("b", "due"), ("c", "tre"))), "d": Rows("note string, hash string", (("a", "bf0ec3694e122e067d9964a38ec7d841"), ("b", "0"), ("z", "1")))},
    "SELECT note, sha256(text)[1:32] AS hash FROM w WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.note = w.note AND d.hash = sha256(w.text)[1:32])",
)
def changed_work(work: DataFrame, done: DataFrame) -> DataFrame:
    """Pending by fingerprint: what was never done, or has another text since."""
    return structure.pending(work.select("note", media.fingerprint(F.col("text")).alias("hash")), done, keys=["note", "hash"])


def _boxes(page: int, *words: tuple[float, float, float, float, str]) -> list[tuple]:
    """Words by left and upper edge, height and width."""
    return [(1, page, float(x), float(y), float(x + w), float(y + h), t) for x, y, h, w, t in words]


#: Page 1: a line of prose, a table of three rows of four numbers, a ragged last row, text. Page 2: a
#: formula with a raised and a lowered word, prose. Page 3: two formulas in two columns. Page 4: numbers
#: in a formula that touches a table.
BOXES = Rows(
    "doc_id bigint, page int, x0 double, y0 double, x1 double, y1 double, txt string",
    tuple(
        _boxes(1, *((40 * i, 0, 10, 30, "parola") for i in range(30)), *((100 * c, 20 + 12 * r, 10, 20, str(10 * r + c)) for r in range(3) for c in range(4)), (0, 56, 10, 20, "99"), (0, 70, 10, 60, "testo"))
        + _boxes(2, (0, 0, 10, 8, "s"), (9, -1, 6, 4, "2"), (20, 0, 10, 8, "="), (35, 0, 10, 8, "n"), (44, 7, 6, 4, "i"), (55, 0, 10, 8, "+"), (70, 0, 10, 8, "1"), *((60 * i, 40, 10, 50, "prosa") for i in range(4)))
        + _boxes(3, (0, 0, 10, 8, "a"), (12, 0, 10, 8, "="), (24, 0, 10, 8, "∞"), (200, 0, 10, 8, "c"), (212, 0, 10, 8, "≤"), (224, 0, 10, 8, "∞"))
    ),
)


@sample(
    "stated_page_structure",
    {"w": BOXES},
    """SELECT * FROM (VALUES (1::BIGINT, 1, 'table', 0, 0.0::DOUBLE, 20.0::DOUBLE, 320.0::DOUBLE, 66.0::DOUBLE, NULL), (1, 2, 'formula', 0, NULL, NULL, NULL, NULL, 's^2 = n_i + 1'),
    (1, 3, 'formula', 0, NULL, NULL, NULL, NULL, 'a = ∞' || chr(10) || 'c ≤ ∞')) AS t(doc_id, page, kind, block, x0, y0, x1, y1, body)""",
)
def stated_page_structure(words: DataFrame) -> DataFrame:
    """W5 with P12, J10, W6, W13, P13, W7. The SQL states what a reader sees."""
    return geometry.page_structure(words)


@sample(
    "stated_page_texts",
    {"w": BOXES},
    """AND p AS (SELECT page, string_agg(txt, ' ' ORDER BY y0, x0) AS prose FROM w GROUP BY page), c AS (SELECT page, string_agg(line, chr(10) ORDER BY y0) AS crop FROM (SELECT page, y0, string_agg(txt, ' ' ORDER BY x0) AS line FROM w WHERE page = 1 AND y0 BETWEEN 20 AND 56 GROUP BY page, y0) GROUP BY page)
    SELECT page, prose || CASE page WHEN 1 THEN chr(10) || chr(10) || '<!-- tabella pag 1 blocco 1 -->' || chr(10) || chr(10) || '```' || chr(10) || chr(10) || crop || chr(10) || chr(10) || '```' ELSE chr(10) || chr(10) || '<!-- formula pag ' || page || ' blocco 1 -->' || chr(10) || chr(10) || '```' || chr(10) || chr(10) || CASE page WHEN 2 THEN 's^2 = n_i + 1' ELSE 'a = ∞' || chr(10) || 'c ≤ ∞' END || chr(10) || chr(10) || '```' END AS body FROM p LEFT JOIN c USING (page)""",
)
def stated_page_texts(words: DataFrame) -> DataFrame:
    """F27, F28."""
    found = geometry.page_texts(words)
    return found.select("page", notes.page_body(F.col("prose"), F.col("tables"), F.col("formulas"), F.col("page")).alias("body"))


LONG = Rows(
    "id bigint, text string",
    (
        (1, "# A\n" + "x " * 200 + "\n# B\n" + "y " * 200),
        (2, "breve"),
        (3, "uno. " * 90 + "\n\n" + "due. " * 90),
        (4, "a" * 300 + " " + "b" * 300),
        (5, None),
    ),
)


@sample(
    "stated_chunks",
    {"l": LONG},
    """SELECT * FROM (SELECT 1::BIGINT AS id, 0 AS part, '# A' || chr(10) || trim(repeat('x ', 200)) AS chunk UNION ALL SELECT 1, 1, '# B' || chr(10) || trim(repeat('y ', 200)) UNION ALL SELECT 2, 0, 'breve'
    UNION ALL SELECT 3, 0, trim(repeat('uno. ', 90)) UNION ALL SELECT 3, 1, trim(repeat('due. ', 90)) UNION ALL SELECT 4, 0, repeat('a', 300) UNION ALL SELECT 4, 1, repeat('b', 300))""",
)
def stated_chunks(long: DataFrame) -> DataFrame:
    """cut at titles, paragraphs and words. The SQL states the parts."""
    return long.select("id", F.posexplode(chunking.chunks(F.col("text"), 500)["chunks"]).alias("part", "chunk")).withColumn("chunk", F.trim("chunk"))


@sample(
    "stated_coverage",
    {"l": LONG},
    "SELECT 4::BIGINT AS n_sources, 1::BIGINT AS n_left_out, 3::BIGINT AS n_divided, 6::BIGINT AS n_chunks",
)
def stated_coverage(long: DataFrame) -> DataFrame:
    """One is too short, three are cut in two."""
    told = long.where("text is not null").select("text", chunking.chunks(F.col("text"), 500).alias("parts"))
    return chunking.coverage(told).select("n_sources", "n_left_out", "n_divided", "n_chunks")
