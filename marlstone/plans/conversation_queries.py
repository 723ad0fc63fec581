"""Queries over conversations: facts, contexts, measures, attribution, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import lexicons
from marlstone.functions.text import function_word_language, message_text
from marlstone.operators import facts
from marlstone.plans.catalogue import register
from marlstone.session import table


def _list(values) -> str:
    return "['" + "', '".join(v.replace("'", "''") for v in values) + "']"


_ABBR = "|".join(sorted((a.replace(".", r"\.").replace("'", "''") for a in lexicons.ABBREVIATIONS), key=len, reverse=True))
_QUOTE = "[''\"()\\[\\]{}·]"

# A dot behind an abbreviation, or between digits, is held by a private character. Twice, as a match takes its
# surroundings along.
_HELD = rf"regexp_replace(@, '(^|[ \t\n\r])({_QUOTE}*(?i:{_ABBR})[''\"()\[\]{{}}:,;!?]*[ \t\n\r\"'']*)\.', '\1\2' || chr(57344), 'g')"
_DIGIT = r"regexp_replace(regexp_replace(@, '([0-9])\.([0-9])', '\1' || chr(57344) || '\2', 'g'), '([0-9])\.([0-9])', '\1' || chr(57344) || '\2', 'g')"

SENTENCES = rf"""
said AS (SELECT conv_id, turn, array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n'), lambda x: trim(x)),
  lambda x: x <> '' AND NOT (starts_with(x, '[') AND ends_with(x, ']') AND contains(x, ':'))), ' ') AS t FROM conversations WHERE role = 'user'),
held AS (SELECT conv_id, turn, {_HELD.replace('@', _DIGIT.replace('@', 't'))} AS t FROM said),
cut AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(t, '(?s)[^.!?;:]*(?:[.!?][.!?:]*|[;:]+)|[^.!?;:]+$'), lambda s: trim(replace(s, chr(57344), '.'))), lambda s: s <> '') AS ss FROM held),
sentences AS (SELECT conv_id, turn, (unnest(range(len(ss))))::INTEGER AS seq, unnest(ss) AS sentence FROM cut),
w AS (SELECT *, regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]+') AS ws FROM sentences),
f AS (SELECT *, ws[1:5] AS fs, len(list_intersect(ws, {_list(lexicons.FIRST_PERSON)})) > 0 OR regexp_matches(' ' || array_to_string(ws, ' ') || ' ', ' ({'|'.join(lexicons.FIRST_PERSON_PAIRS)}) ') AS me FROM w),
classified AS (SELECT conv_id, turn, seq, sentence, CASE
  WHEN trim(sentence) = '' THEN 'vuota'
  WHEN rtrim(sentence) LIKE '%?' THEN 'domanda'
  WHEN coalesce(list_contains({_list([*lexicons.IMPERATIVES, *lexicons.REQUESTS])}, fs[1]), false) OR list_contains({_list(lexicons.REQUEST_PAIRS)}, array_to_string(fs[1:2], ' ')) OR len(list_intersect(fs[2:4], {_list(lexicons.IMPERATIVES)})) > 0 THEN 'imperativo'
  WHEN NOT me AND (coalesce(list_contains({_list(lexicons.ADDRESSED_FIRST)}, fs[1]), false) OR (fs[1] = 'non' AND coalesce(list_contains({_list(lexicons.ADDRESSED_AFTER_NOT)}, fs[2]), false)) OR len(list_intersect(fs, {_list(lexicons.ADDRESSED_ANY)})) > 0) THEN 'sull''assistente'
  WHEN len(ws) < 2 THEN 'troppo breve'
  WHEN me THEN 'prima persona'
  ELSE 'non sul parlante' END AS reason FROM f),
facts AS (SELECT *, CASE WHEN reason = 'prima persona' THEN 'fact' WHEN reason = 'non sul parlante' AND bool_or(reason = 'prima persona') OVER (PARTITION BY conv_id, turn) THEN 'context' ELSE 'discarded' END AS kind FROM classified)"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@register("user_messages_sorted", "SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'user' ORDER BY conv_id, turn")
def user_messages_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).orderBy("conv_id", "turn")


@register("conversation_headers", "SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n_messages, count(*) FILTER (WHERE role = 'user') AS n_user FROM conversations GROUP BY conv_id")
def conversation_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.headers(_messages(spark, sf_dir))


@register("archive_totals", "SELECT count(*) AS n_conversations, coalesce(sum(n), 0)::BIGINT AS n_messages FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def archive_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.headers(_messages(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_conversations"), F.coalesce(F.sum("n_messages"), F.lit(0)).alias("n_messages"))


@register("sentence_split", f"WITH {SENTENCES} SELECT conv_id, turn, seq, sentence FROM sentences")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.classified(_messages(spark, sf_dir)).select("conv_id", "turn", "seq", "sentence")


@register("fact_classification", f"WITH {SENTENCES} SELECT conv_id, turn, seq, reason FROM classified")
def fact_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.classified(_messages(spark, sf_dir)).select("conv_id", "turn", "seq", "reason")


@register("fact_context", f"WITH {SENTENCES} SELECT conv_id, turn, seq, sentence, kind FROM facts WHERE kind <> 'discarded'")
def fact_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.facts(_messages(spark, sf_dir)).where("kind != 'discarded'").select("conv_id", "turn", "seq", "sentence", "kind")


@register("discard_histogram", f"WITH {SENTENCES} SELECT reason, count(*) AS n FROM facts WHERE kind = 'discarded' GROUP BY reason")
def discard_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.facts(_messages(spark, sf_dir)).where("kind = 'discarded'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register("facts_per_conversation", f"""WITH {SENTENCES},
n AS (SELECT conv_id, count(*) FILTER (WHERE kind <> 'discarded') AS kept, count(*) FILTER (WHERE kind = 'discarded') AS discarded FROM facts GROUP BY conv_id),
all_ AS (SELECT c.conv_id, coalesce(kept, 0) AS kept, coalesce(discarded, 0) AS discarded FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n USING (conv_id))
SELECT count(*) AS n_conversations, sum(kept)::BIGINT AS kept, sum(discarded)::BIGINT AS discarded, min(kept) AS least, max(kept) AS most, median(kept)::DOUBLE AS median_kept, count(*) FILTER (WHERE kept = 0) AS without_facts FROM all_""")
def facts_per_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures over all conversations, those without any sentence included."""
    messages = _messages(spark, sf_dir)
    each = facts.facts(messages).groupBy("conv_id").agg(F.count_if(F.col("kind") != "discarded").alias("kept"), F.count_if(F.col("kind") == "discarded").alias("discarded"))
    all_ = messages.select("conv_id").distinct().join(each, "conv_id", "left").fillna(0, ["kept", "discarded"])
    return all_.agg(
        F.count(F.lit(1)).alias("n_conversations"),
        F.sum("kept").alias("kept"),
        F.sum("discarded").alias("discarded"),
        F.min("kept").alias("least"),
        F.max("kept").alias("most"),
        F.percentile("kept", 0.5).alias("median_kept"),
        F.count_if(F.col("kept") == 0).alias("without_facts"),
    )


@register("history_shape", "SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'assistant' WHEN role = 'system' THEN 'instruction' ELSE 'plain' END AS shape, CASE WHEN role = 'system' THEN NULL ELSE text END AS content FROM conversations")
def history_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as the model gets them: what each role becomes, with content left out where another column has it."""
    shape = F.when(F.col("role") == "assistant", "assistant").when(F.col("role") == "system", "instruction").otherwise("plain")
    return _messages(spark, sf_dir).select("conv_id", "turn", shape.alias("shape"), F.when(F.col("role") != "system", F.col("text")).alias("content"))


@register("rolled_back_turn", "SELECT conv_id, turn, role FROM (SELECT *, max(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS cut FROM conversations) WHERE cut IS NULL OR turn < cut")
def rolled_back_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations without their last turn: nothing from the last user message on stays."""
    messages = _messages(spark, sf_dir)
    cut = messages.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("cut"))
    return messages.join(cut, "conv_id", "left").where("cut is null or turn < cut").select("conv_id", "turn", "role")


@register("transcripts", "SELECT conv_id, string_agg('[' || role || '] ' || trim(text), chr(10) ORDER BY turn) AS transcript FROM conversations WHERE trim(coalesce(text, '')) <> '' GROUP BY conv_id")
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.transcripts(_messages(spark, sf_dir))


@register("message_parts", r"""SELECT conv_id, turn, (unnest(range(len(ps))))::INTEGER AS part, unnest(ps) AS body FROM (
  SELECT conv_id, turn, list_transform(range(0, greatest(length(text), 1), 100), lambda i: substring(text, i + 1, 100)) AS ps FROM conversations WHERE text IS NOT NULL)""")
def message_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: messages in parts of 100 characters (the limit of the real channel, 4000, is never reached here)."""
    from marlstone.functions.text import parts

    return _messages(spark, sf_dir).where("text is not null").select("conv_id", "turn", F.posexplode(parts(F.col("text"), 100)).alias("part", "body"))


@register("function_word_language", rf"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS ws FROM conversations),
n AS (SELECT conv_id, turn, len(list_filter(ws, lambda x: list_contains({_list(lexicons.ITALIAN_WORDS)}, x))) AS it, len(list_filter(ws, lambda x: list_contains({_list(lexicons.ENGLISH_WORDS)}, x))) AS en FROM w),
l AS (SELECT CASE WHEN it >= 2 AND it > 1.5 * en THEN 'italiano' WHEN en >= 2 AND en > 1.5 * it THEN 'inglese' ELSE 'misto/indeterminato' END AS lingua FROM n)
SELECT lingua, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER ()::DOUBLE AS share FROM l GROUP BY lingua""")
def language_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by the language of their function words."""
    found = _messages(spark, sf_dir).groupBy(function_word_language(F.coalesce("text", F.lit(""))).alias("lingua")).agg(F.count(F.lit(1)).alias("n"))
    total = found.agg(F.sum("n").alias("total"))
    return found.crossJoin(F.broadcast(total)).select("lingua", "n", (F.col("n").cast("double") / F.col("total")).alias("share"))  # one row


_COMMON = r"""CASE WHEN length(q) < 20 THEN 0 WHEN t = '' THEN 0 WHEN contains(t, q) THEN length(q) ELSE coalesce(length(list_filter(
  flatten(list_transform(range(least(15, len(ws)), least(4, len(ws)) - 1, -1), lambda k: list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' ')))),
  lambda r: contains(t, r))[1]), 0) END"""
_QUOTE_FORM = r"regexp_replace(regexp_replace(trim(lower(@)), '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s]', '', 'g')"

QUOTED = rf"""
quoted AS (SELECT conv_id, turn AS quote_id, role AS said_by, array_to_string(string_split(text, ' ')[3:14], ' ') AS quote FROM conversations WHERE text IS NOT NULL),
asked AS (SELECT conv_id, quote_id, {_QUOTE_FORM.replace('@', 'quote')} AS q FROM quoted),
msgs AS (SELECT conv_id, turn, role, {_QUOTE_FORM.replace('@', "coalesce(text, '')")} AS t FROM conversations),
met AS (SELECT a.conv_id, quote_id, m.turn, m.role, ({_COMMON})::BIGINT AS n FROM (SELECT *, regexp_extract_all(q, '[\p{{L}}\p{{N}}_]+') AS ws FROM asked) a JOIN msgs m ON m.conv_id = a.conv_id),
best AS (SELECT conv_id, quote_id, max(n) AS match_len, arg_max(role, n * 100000 - turn) AS r FROM met GROUP BY ALL),
found AS (SELECT conv_id, quote_id, CASE WHEN match_len >= 16 THEN r END AS quoted_role, match_len FROM best)"""


def _quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each message its third to fourteenth word, as quotes."""
    return _messages(spark, sf_dir).where("text is not null").select("conv_id", F.col("turn").alias("quote_id"), F.col("role").alias("said_by"), F.array_join(F.slice(F.split("text", " "), 3, 12), " ").alias("quote"))


@register("quote_attribution", f"WITH {QUOTED} SELECT conv_id, quote_id, quoted_role, match_len FROM found")
def quote_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.attributed(_quoted(spark, sf_dir), _messages(spark, sf_dir))


@register("attribution_rollup", f"""WITH {QUOTED}
SELECT said_by, count(*) AS n_quotes, count(*) FILTER (WHERE quoted_role = 'user') AS n_user, count(*) FILTER (WHERE quoted_role = 'assistant') AS n_assistant, count(*) FILTER (WHERE quoted_role IS NULL) AS n_none,
  count(*) FILTER (WHERE quoted_role = 'assistant') / count(*)::DOUBLE AS wrong_share
FROM found JOIN quoted USING (conv_id, quote_id) GROUP BY ROLLUP (said_by)""")
def attribution_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = _quoted(spark, sf_dir)
    found = facts.attributed(quoted, _messages(spark, sf_dir)).join(quoted.select("conv_id", "quote_id", "said_by"), ["conv_id", "quote_id"])
    return facts.error_rates(found, by=["said_by"])


@register("fact_attribution", f"""WITH {SENTENCES}
SELECT count(*) AS n_facts, count(*) FILTER (WHERE contains(s.t, f.sentence)) AS n_verbatim FROM facts f JOIN said s USING (conv_id, turn) WHERE kind = 'fact'""")
def fact_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts looked up by their message's id, and whether it holds them word for word."""
    messages = _messages(spark, sf_dir)
    found = facts.facts(messages).where("kind = 'fact'").join(messages.where("role = 'user'").select("conv_id", "turn", message_text(F.col("text")).alias("t")), ["conv_id", "turn"])
    return found.agg(F.count(F.lit(1)).alias("n_facts"), F.count_if(F.contains("t", "sentence")).alias("n_verbatim"))
